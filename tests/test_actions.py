"""Actions on hand-made scenes: every branch of the possession and flight rules."""

import numpy as np
import pandas as pd
import pytest

from framelake.operators import actions as A
from framelake.operators.throws import GRAVITY, along

FPS = 30
HOOP = np.array([0.0, 0.0, A.RIM])
FAR = np.array([50.0, 50.0, 1.0])


def arc(start, end, n):
    """Points of a throw from ``start`` to ``end`` over n frames, ends included."""
    t = n / FPS
    v = (np.array(end, float) - start) / t
    v[2] += 0.5 * GRAVITY * t
    return along(np.arange(n + 1) / FPS, np.array(start, float), v)


class Play:
    """A scene frame by frame: the ball with its state, hands by player, feet below them unless given."""

    def __init__(self):
        self.p, self.state, self.hands, self.feet, self.spans = [], [], [], [], []

    def add(self, points, state, hands, feet=None):
        for i, x in enumerate(points):
            self.p.append(np.full(3, np.nan) if x is None else np.array(x, float))
            self.state.append(state)
            now = {k: np.array(h(i) if callable(h) else h, float) for k, h in hands.items()}
            self.hands.append(now)
            self.feet.append({k: (feet or {}).get(k, lambda i, h=h: h)(i)[:2] for k, h in now.items()})
        if state == "flight":
            self.spans.append((len(self.p) - len(points), len(self.p) - 1))
        return self

    def rows(self, first=100):
        v = np.diff(np.array(self.p), axis=0, prepend=[self.p[0]]) * FPS
        people = [[{"player": k, "hand": dict(zip("xyz", h, strict=True)), "foot": dict(zip("xy", f[k], strict=True))} for k, h in sorted(hands.items())] or None for hands, f in zip(self.hands, self.feet, strict=True)]
        table = pd.DataFrame(np.hstack([self.p, v]), columns=["x", "y", "z", "vx", "vy", "vz"])
        return table.assign(frame=np.arange(first, first + len(table)), state=self.state, people=people)

    def run(self, spans=None, first=100, **rules):
        spans = self.spans if spans is None else spans
        found, self.owner = A.segment_actions(self.rows(first), [(a + first, b + first) for a, b in spans], HOOP, FPS, A.ActionRules(**rules))
        return found


def brief(found, *kinds):
    return [(x.type, x.actor, x.receiver, x.more.get("result")) for x in found if not kinds or x.type in kinds]


def held(at, n=15):
    return [np.array(at, float)] * n


def shot(to=(0.0, 0.0, 2.9), start=(5.0, 0.0, 2.2), n=36, after=25, rest=(0.0, 0.0, 0.1), others=None, fall=True):
    """A holds, shoots; the ball drops to the floor below where the arc ends."""
    play = Play().add(held(start), "held", {"a": start} | (others or {}))
    play.add(arc(start, to, n)[1:], "flight", {"a": start} | (others or {}))
    last = play.p[-1]
    drop = [np.array([last[0], last[1], max(0.1, last[2] - 0.2 * (k + 1))]) for k in range(after)] if fall else [rest] * after
    return play.add(drop, "unknown", {"a": FAR} | (others or {}))


def test_a_make_with_its_release():
    play = shot()
    found = play.run()
    assert brief(found) == [("shoot", "a", None, "make"), ("release", "a", None, None)]
    one = found[0]
    assert one.more["three"] is False and one.more["apex"] > 3.05 and abs(one.more["release_distance"] - 5) < 0.5
    assert play.owner[5] == "a" and play.owner[30] is None


def test_a_three_and_a_miss_with_a_rebound():
    assert shot(start=(7.0, 0.0, 2.2), n=40).run()[0].more["three"] is True
    wide = (0.6, 0.0, 2.9)
    assert brief(shot(to=wide).run(), "shoot", "rebound") == [("shoot", "a", None, "miss")]
    grab = {"b": lambda i: (0.6, 0.0, 2.0)}
    found = shot(to=wide, others=grab).run()
    grabs = [x for x in found if x.type == "rebound"]
    assert [x.actor for x in grabs] == ["b"] and grabs[0].more == {"after": "shoot"} and grabs[0].frame > next(x for x in found if x.type == "shoot").frame
    # Once the ball has hit the floor there is no rebound.
    low = {"b": lambda i: (0.6, 0.0, -0.2)}
    assert not [x for x in shot(to=wide, others=low).run() if x.type == "rebound"]


def test_a_shot_needs_a_thrower_and_the_way_to_the_hoop():
    start = (5.0, 0.0, 2.2)
    alone = Play().add(held(start), "unknown", {}).add(arc(start, (0, 0, 2.9), 36)[1:], "flight", {}).add(held((0, 0, 0.1)), "unknown", {})
    assert not [x for x in alone.run() if x.type in ("shoot", "layup")]
    away = Play().add(held((0.3, 0, 2.2)), "held", {"a": (0.3, 0, 2.2)}).add(arc((0.3, 0, 2.2), (6, 0, 1.0), 36)[1:], "flight", {"a": (0.3, 0, 2.2)})
    assert [x.type for x in away.run() if x.type not in ("release",)] == ["layup"]  # close to the hoop, caught by nobody


def test_layup_on_the_drive():
    start = (1.2, 0.0, 2.3)
    run = {"a": lambda i: (1.2 + 0.15 * (14 - i), 0.0, 1.0)}
    play = Play()
    play.add([(1.2 + 0.15 * (14 - i), 0, 1.2) for i in range(15)], "held", {"a": lambda i: (1.2 + 0.15 * (14 - i), 0.0, 1.2)}, run)
    play.add(arc(start, (0, 0, 2.9), 18)[1:], "flight", {"a": start}).add([(0, 0, max(0.1, 2.7 - 0.2 * k)) for k in range(20)], "unknown", {"a": FAR})
    found = play.run()
    assert brief(found, "layup", "shoot") == [("layup", "a", None, "make")]
    still = Play().add(held((1.2, 0, 2.3)), "held", {"a": (1.2, 0, 2.3)}).add(arc(start, (0, 0, 2.9), 18)[1:], "flight", {"a": start}).add([(0, 0, max(0.1, 2.7 - 0.2 * k)) for k in range(20)], "unknown", {"a": FAR})
    assert brief(still.run(), "layup", "shoot") == [("shoot", "a", None, "make")]


def test_follow_up_after_a_miss_only():
    def scene(to, gap):
        play = shot(to=to, others={"b": FAR}, after=8)
        play.add(held((0.5, 0, 2.0), 25), "held", {"a": FAR, "b": (0.5, 0, 2.0)})
        play.add([None] * gap, "unknown", {"a": FAR, "b": FAR})
        play.add(held((0.5, 0, 2.0), 4), "held", {"b": (0.5, 0, 2.0)})
        play.add(arc((0.5, 0, 2.0), (0, 0, 2.9), 24)[1:], "flight", {"b": (0.5, 0, 2.0)})
        return play.add([(0, 0, max(0.1, 2.7 - 0.2 * k)) for k in range(30)], "unknown", {"b": FAR})

    assert brief(scene((0.6, 0, 2.9), 0).run(), "shoot", "follow_up") == [("shoot", "a", None, "miss"), ("follow_up", "b", None, "make")]
    assert "follow_up" not in [x.type for x in scene((0.0, 0, 2.9), 0).run()]
    assert "follow_up" not in [x.type for x in scene((0.6, 0, 2.9), 95).run()]


def test_pass_catch_and_who_lets_go():
    a, b = (8.0, 0.0, 1.4), (8.0, 6.0, 1.4)
    hand = lambda i: b if i >= 18 else (8.0, 9.0, 1.4)
    play = Play().add(held(a), "held", {"a": a, "b": b}).add(arc(a, b, 20)[1:], "flight", {"a": a, "b": hand}).add(held(b), "held", {"a": a, "b": b})
    found = play.run()
    assert brief(found, "pass") == [("pass", "a", "b", None)] and next(x for x in found if x.type == "pass").more["span"] > 5
    # The hand meets the ball before the flight ends, and the ball stays: a catch there, none when it is held.
    catches = [(x.actor, x.frame) for x in found if x.type == "catch"]
    assert len(catches) == 1 and catches[0][0] == "b" and catches[0][1] == 133
    assert play.owner[-1] == "b" and play.owner[20] is None
    short = Play().add(held(a), "held", {"a": a}).add(arc(a, (8, 1.2, 1.4), 20)[1:], "flight", {"a": a, "b": (8, 1.2, 1.4)})
    assert not [x for x in short.run() if x.type == "pass"]


def test_a_jolt_is_no_shot():
    start = (5.0, 0.0, 2.2)
    play = Play().add(held((5.0, 0.0, 1.45)), "held", {"a": start}).add(arc(start, (0, 0, 2.9), 36)[1:], "flight", {"a": start}).add(held((0, 0, 0.1)), "unknown", {"a": FAR})
    assert not [x for x in play.run() if x.type == "shoot"]


def test_hand_over_and_dribbles():
    a, b = np.array([8.0, 0, 1.1]), np.array([8.4, 0, 1.1])
    play = Play().add(held(a, 6), "held", {"a": a, "b": b + [0.5, 0, 0]}).add(held(b, 6), "held", {"a": a - [1, 0, 0], "b": b})
    assert brief(play.run()) == [("catch", "b", None, None), ("pass", "a", "b", None)] and play.run()[1].more == {"handoff": True}
    low = [(8.0 + 0.05 * k, 0, 0.5) for k in range(12)]
    play = Play().add(held(a, 4), "held", {"a": a}).add(low, "unknown", {"a": lambda i: (8.0 + 0.05 * i, 0, 0.9)}).add(held((30, 30, 1.0), 40), "unknown", {"a": a})
    found = play.run()
    assert [(x.type, x.actor, x.more) for x in found] == [("dribble_start", "a", {"fallback": True}), ("dribble_end", "a", {})]
    assert found[0].frame == 100 + 4 + 4 and found[1].frame == 100 + 16
    # The handler is kept for thirty frames without a touch.
    assert play.owner[45] == "a" and play.owner[46] is None
    change = Play().add(held(a, 4), "held", {"a": a}).add([(x, y, 1.08) for x, y, _ in low], "dribble", {"a": FAR, "b": lambda i: (8.0 + 0.05 * i, 0, 0.9)})
    assert brief(change.run()) == [("catch", "b", None, None)] and change.run()[0].frame == 108


def test_low_pass():
    a, b = np.array([10.0, 0, 0.9]), np.array([10.0, 5.0, 0.9])
    roll = [(10, 0.25 * k, 0.5) for k in range(1, 20)]
    play = Play().add(held(a, 5), "held", {"a": a, "b": b}).add(roll, "ground", {"a": a, "b": b}).add(held((10, 4.8, 0.6), 5), "ground", {"a": a, "b": b})
    assert [(x.type, x.actor, x.receiver, x.more) for x in play.run() if x.more.get("low")] == [("pass", "a", "b", {"low": True})]
    assert not [x for x in play.run(low_frames=10) if x.more.get("low")]
    high = Play().add(held(a, 5), "held", {"a": a, "b": b}).add([(x, y, 1.8) for x, y, _ in roll], "ground", {"a": a, "b": b}).add(held((10, 4.8, 0.6), 5), "ground", {"a": a, "b": b})
    assert not [x for x in high.run() if x.more.get("low")]


def test_launches_that_no_flight_covers_count():
    play = shot()
    assert brief(play.run(spans=[]), "shoot") == [("shoot", "a", None, "make")]
    whole = play.run()
    assert len(brief(whole, "shoot")) == 1


def plain_arcs(s, r):
    """Arcs and their releases frame by frame."""
    out, start, last = [], None, None
    for f in range(len(s)):
        if not s.seen[f]:
            if start is not None and f - last > 8:
                out.append((start, last))
                start = None
            continue
        last, z = f, s.p[f, 2]
        if start is None:
            start = f if z >= 1.8 else None
        elif z < 1.8 and (z < 1.2 or (s.reach[f] <= 0.5 and f and s.reach[f - 1] <= 0.5)):
            out.append((start, f))
            start = None
    if start is not None:
        out.append((start, last))
    done = []
    for a, b in out:
        while a >= 1 and s.seen[a - 1] and s.seen[a]:
            near, nearer = s.reach[a - 1], s.reach[a - 2] if a >= 2 else np.inf
            speed = np.linalg.norm(s.p[a] - s.p[a - 1]) * FPS
            if (near <= 0.9 and nearer <= 0.9) or (s.p[a - 1, 2] < 1.2 and (speed < 2 or near <= 1.2)):
                break
            a -= 1
        done.append((a, b))
    return done


def plain_extended(s, spans):
    out = []
    for a, b in spans:
        while a >= 1 and s.seen[a - 1] and s.seen[a]:
            if s.p[a - 1, 2] > 1.4 or np.linalg.norm(s.p[a] - s.p[a - 1]) * FPS < 2 or s.reach[a - 1] <= 0.9:
                break
            a -= 1
        while b + 1 < len(s) - 1 and s.seen[b + 1] and s.seen[b]:
            if s.p[b + 1, 2] <= 1.9 or np.linalg.norm(s.p[b + 1] - s.p[b]) * FPS <= 2:
                break
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def plain_low_passes(s):
    out, start = [], None
    for f in range(len(s)):
        if not s.seen[f] or f == 0 or not s.seen[f - 1]:
            start = None
            continue
        v, z = np.linalg.norm(s.p[f] - s.p[f - 1]) * FPS, s.p[f, 2]
        if start is None:
            start = f if z <= 1.7 and v >= 3 and s.state[f] != "held" else None
        elif z > 1.7:
            start = None
        elif v < 1.8:
            if s.reach[f] <= 0.9 and s.reach[start - 1] <= 0.95 and s.player(start - 1) != s.player(f):
                out.append((start, f, s.player(start - 1), s.player(f)))
            start = None
        elif f - start > 60:
            start = None
    return out


def random_scene(seed):
    r = np.random.default_rng(seed)
    play, at = Play(), np.array([3.0, 0, 1.2])
    for _ in range(14):
        n, kind = int(r.integers(3, 40)), r.integers(0, 5)
        hands = {k: at + r.normal(0, r.choice([0.3, 2.0]), 3) for k in "abc" if r.random() < 0.7}
        if kind == 0:
            points, state = [None if r.random() < 0.6 else at for _ in range(n)], "unknown"
        elif kind == 1:
            points, state = arc(at, at + r.normal(0, 3, 3) * [1, 1, 0.1], max(8, n))[1:], "flight"
            points[:, 2] = np.maximum(points[:, 2], 0.1)
        elif kind == 2:
            points, state = [at + [0.12 * k, 0, 0.3 * np.sin(k) - 0.4] for k in range(n)], str(r.choice(["dribble", "ground"]))
        else:
            points, state = [at + r.normal(0, 0.03, 3) for _ in range(n)], "held"
        play.add(list(points), state, hands)
        seen = [x for x in play.p if np.isfinite(x).all()]
        at = np.clip(seen[-1], [-9, -9, 0.3], [9, 9, 2.6])
    return play


@pytest.mark.parametrize("seed", range(30))
def test_arrays_match_plain_loops(seed):
    play = random_scene(seed)
    s, r = A.Scene(play.rows(), FPS), A.ActionRules()
    assert A.launch_arcs(s, r) == plain_arcs(s, r)
    spans = A.merge_flights([*play.spans, *A.launch_arcs(s, r)], 5)
    assert A.extended(s, spans, r) == plain_extended(s, spans)
    assert [(x.frame - 100, x.end - 100, x.actor, x.receiver) for x in A.low_passes(s, r)] == plain_low_passes(s)
    play.run()


def test_possession_can_be_saved_between_any_two_frames():
    for seed in range(8):
        s = A.Scene(random_scene(seed).rows(), FPS)
        want, owner = s.possession(A.ActionRules())
        got, machine = [], A.Possession()
        for i in range(len(s)):
            machine = A.Possession(saved=machine.saved())
            got += machine.step(s.first + i, s.state[i], s.p[i] if s.seen[i] else None, None if np.isnan(s.speed[i]) else s.speed[i], s.hands[i])
            assert machine.owner == owner[i]
        assert got == want


def test_make_and_miss():
    fall = lambda x, z=(3.4, 3.2, 2.9, 2.6, 2.2): np.array([(x, 0.0, h) for h in z])
    assert A.shot_result(fall(0.2), HOOP) == "make" and A.shot_result(fall(0.75), HOOP) == "miss"
    # Off the middle, but through the opening all the way down; then out of it.
    assert A.shot_result(fall(0.45), HOOP) == "make"
    out = fall(0.45)
    out[3, 0] = 0.9
    assert A.shot_result(out, HOOP) == "miss"
    assert A.shot_result(fall(0.45, (3.4, 3.2, 2.3)), HOOP) == "miss"  # no point in the band
    assert A.shot_result(fall(0.2, (3.06, 3.04, 3.0)), HOOP) == "make"  # too slow a crossing, but it falls through
    assert A.shot_result(fall(0.6, (3.06, 3.04, 3.0)), HOOP) == "miss"
    assert A.shot_result(fall(0.0, (2.0, 2.5, 2.9, 3.0)), HOOP) == "miss"
    cross = np.array([(1.0, 0, 3.15), (-0.6, 0, 2.95)])
    assert A.shot_result(cross, HOOP) == "make" and A.shot_result(cross + [0, 0.35, 0], HOOP) == "miss"


def test_table_of_actions(spark):
    play = shot()
    frames = play.rows()
    balls = [("s", int(r.frame), *(float(r[c]) if np.isfinite(r[c]) else None for c in ("x", "y", "z", "vx", "vy", "vz")), r.state) for _, r in frames.iterrows()]
    joints = lambda h: [(float(h[0]), float(h[1]), float(h[2]))] * 17
    poses = [("s", 100 + i, k, joints(h)) for i, hands in enumerate(play.hands) for k, h in hands.items()]
    b = spark.createDataFrame(balls, "segment string, frame long, x double, y double, z double, vx double, vy double, vz double, state string")
    p = spark.createDataFrame(poses, "segment string, frame long, player string, keypoints array<struct<x:double,y:double,z:double>>")
    f = spark.createDataFrame([("s", x + 100, y + 100, "flight") for x, y in play.spans] + [("s", 0, 99, "dribble")], "segment string, start long, end long, kind string")
    got = A.actions(b, f, p, (0.0, 0.0), FPS).collect()
    assert [(r["type"], r["actor"], r["result"], r["three"]) for r in got] == [("shoot", "a", "make", False), ("release", "a", None, None)]
    assert A.actions(b.limit(0), f, p, (0.0, 0.0), FPS).count() == 0
    assert [r["type"] for r in A.actions(b, f.limit(0), p.limit(0), (0.0, 0.0), FPS).collect()] == []
