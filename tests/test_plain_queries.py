"""Registered queries without SQL beside plain loops over the rows that they read from the sample tables."""

import itertools
import math
import os
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_flights import FPS as RATE
from test_flights import plain_bounces, plain_flights, plain_outliers, plain_rts
from test_shots import outcome_loop

from framelake.operators import flights as L
from framelake.plans import boxes, detail, ledger, registry, sampling, tracks, views  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = registry.QUERIES[name](spark, DATA).toPandas()
        return held[name]

    return rows


@pytest.fixture(scope="module")
def thrown(spark):
    balls = tracks.thrown_balls(spark, DATA).toPandas().sort_values(["segment", "frame"])
    out = {}
    for s, g in balls.groupby("segment"):
        f, p = g["frame"].to_numpy(), g[["x", "y", "z"]].to_numpy()
        out[s] = f, p, plain_outliers(f, p, g["views"].to_numpy())
    return out


@pytest.fixture(scope="module")
def obs(spark):
    return views.observations(spark, DATA).toPandas()


def test_outliers(run, thrown):
    got = run("thrown_outliers").sort_values(["segment", "frame"])
    assert {s: g["outlier"].tolist() for s, g in got.groupby("segment")} == {s: bad.tolist() for s, (_, _, bad) in thrown.items()}
    assert 0 < got["outlier"].sum() < len(got) / 4


def test_bounces(run, thrown):
    got = run("thrown_bounces")
    want = {(s, int(x)): v for s, (f, p, bad) in thrown.items() for x, v in plain_bounces(f[~bad], p[~bad])}
    assert {(r.segment, r.frame) for r in got.itertuples()} == set(want) and len(want) > 100
    assert all(math.isclose(r.strength, want[r.segment, r.frame], rel_tol=1e-6) for r in got.itertuples())


def test_flights(run, thrown):
    got = defaultdict(list)
    for r in run("trajectory_flights").sort_values(["segment", "place"]).itertuples():
        got[r.segment].append((r.start, r.end, r.points))
    few = sorted(thrown)[::9]
    assert {s: got[s] for s in few} == {s: plain_flights(f, p, bad) for s in few for f, p, bad in [thrown[s]]}
    assert sum(map(len, got.values())) > 500


def test_filled_positions_and_smoothing(run, thrown):
    for s, g in run("filled_trajectory").sort_values(["segment", "frame"]).groupby("segment"):
        if s % 10:
            continue
        f, p, bad = thrown[s]
        grid = g["frame"].to_numpy()
        assert (grid == np.arange(f[0], f[-1] + 1)).all() and (g["observed"] == np.isin(grid, f[~bad])).all()
        seen = np.full((len(grid), 3), np.nan)
        seen[f[~bad] - grid[0]] = p[~bad]
        flying = np.zeros(len(grid), bool)
        for k in L.flights(f, p, bad, RATE):
            flying[k.start - grid[0] : k.end + 1 - grid[0]] = True
        hit = np.isin(grid, [x for x, _ in plain_bounces(f[~bad], p[~bad])])
        want = plain_rts(grid, seen, flying, hit)
        assert np.allclose(g[["sx", "sy", "sz"]], want[:, :3], atol=1e-6) and np.allclose(g[["vx", "vy", "vz"]], want[:, 3:], atol=1e-5)
        # What is filled lies near the throw that was seen around it, above the floor.
        holes = g[g["filled"]]
        assert (holes["z"] > -0.1).all() and not holes["observed"].any()
        long_hole = (~g["filled"] & ~g["observed"]).to_numpy()
        assert np.isnan(g["x"].to_numpy(float)[long_hole]).all()


def test_reconstruction(run, thrown):
    got = run("reconstructed_ball")
    assert {"flight", "unknown"} < set(got["state"]) and set(got["source"].dropna()) == {"ballistic", "rts"}
    for s, g in got.sort_values(["segment", "frame"]).groupby("segment"):
        f, p, bad = thrown[s]
        seen = np.isin(g["frame"], f[~bad])
        assert (g["observed"] == seen).all() and not g["x"][seen].isna().any() and (g["source"][seen].isna()).all()
        off = np.abs(g["z"][seen].to_numpy(float) - p[~bad][:, 2])
        assert np.median(off) < 0.2


def test_outcomes(run, spark):
    visits, passages, net = (x.toPandas() for x in tracks.rim_evidence(spark, DATA))
    passed, series = defaultdict(list), defaultdict(list)
    for r in passages.itertuples():
        passed[r.segment].append((r.view, r.crossing, r.result))
    for r in net.itertuples():
        series[r.segment].append((r.frame, None if math.isnan(r.change) else r.change))
    want = {}
    for v in visits.itertuples():
        near = [x for x in series[v.segment] if v.begin - 60 <= x[0] <= v.end + 60]
        got = outcome_loop((v.begin, v.end), passed[v.segment], near, "a", 2)
        if got:
            want[v.segment, v.visit] = got
    rows = run("shot_outcomes")
    assert {(r.segment, r.visit): (r.outcome, r.confidence, None if math.isnan(r.resolution) else r.resolution) for r in rows.itertuples()} == want
    assert {w[0] for w in want.values()} == {"made", "missed", "unknown"}


def test_detected_shots(run, spark):
    """Every shot of every segment, from releases to the pass before, in one pass over the visits."""
    seen = defaultdict(set)
    for r in registry.QUERIES["shot_releases"](spark, DATA).toPandas().itertuples():
        seen[r.segment, r.frame, r.player].add(r.view)
    visits, passages, net = (x.toPandas() for x in tracks.rim_evidence(spark, DATA))
    spans = detail._spans(spark, DATA).toPandas()
    got = run("detected_shots")
    for segment in sorted(visits["segment"].unique()):
        passed = [(r.view, r.crossing, r.result) for r in passages[passages.segment == segment].itertuples()]
        series = [(r.frame, None if math.isnan(r.change) else r.change) for r in net[net.segment == segment].itertuples()]
        held = sorted((r.start, r.end, r.owner, -1 if math.isnan(r.team) else r.team) for r in spans[spans.segment == segment].itertuples())
        proposals = sorted((f, who) for s, f, who in seen if s == segment)
        used, shots = set(), []
        for v in sorted(visits[visits.segment == segment].itertuples(), key=lambda v: (v.begin, v.visit)):
            near = [p for p in passed if v.begin - 12 <= p[1] <= v.end]
            if not near:
                continue
            free = [p for p in proposals if p not in used and v.begin - 90 <= p[0] < min(x[1] for x in near)]
            let_go = [(s, e - 1, o) for s, e, o, _ in held if v.begin - 90 <= e - 1 <= v.begin]
            release, player, source = (*free[-1], "proposal") if free else (let_go[-1][1], let_go[-1][2], "control") if let_go else (None, None, None)
            used |= set(free[-1:])
            result = outcome_loop((v.begin, v.end), near, [x for x in series if v.begin - 60 <= x[0] <= v.end + 60])
            shots.append([v.visit, release if release is not None else v.begin, release, player, source, *result])
        shots += [[None, f, f, who, "proposal", "unknown", "probable", None] for f, who in proposals if (f, who) not in used]
        want = []
        anchors = sorted(x[1] for x in shots)
        for visit, anchor, release, player, source, *result in shots:
            passer = when = None
            begun = [i for i, h in enumerate(held) if release is not None and h[0] <= release]
            if begun and begun[-1] > 0:
                a, b = held[begun[-1] - 1], held[begun[-1]]
                close = 0 <= b[0] - a[1] <= 45 and release - b[0] <= 45
                if b[2] == player != a[2] and a[3] == b[3] >= 0 and close and not any(a[1] <= x < b[0] for x in anchors):
                    passer, when = a[2], a[1] - 1
            want.append((visit, anchor, release, player, source, *result, passer, when))
        rows = got[got.segment == segment].sort_values("number")
        assert rows["number"].tolist() == list(range(1, len(want) + 1)) and rows["anchor"].is_monotonic_increasing
        plain = lambda x: None if x is None or x != x else x
        found = [tuple(map(plain, (r.visit, r.anchor, r.release, r.player, r.source, r.outcome, r.confidence, r.resolution, r.passer, r.passed))) for r in rows.itertuples()]
        assert Counter(found) == Counter(want)
    assert got["visit"].isna().any() and got["passer"].notna().any() and set(got["outcome"]) == {"made", "missed", "unknown"}


def test_control_spans(run, obs):
    first = {}
    for r in obs.itertuples():
        key = (r.kind, r.frame // 20)
        first[key] = min(first.get(key, r.track), r.track)
    want = []
    for kind in obs["kind"].unique():
        owner, start, last, other, count = None, 0, 0, None, 0
        for f in sorted(f for k, f in first if k == kind):
            now = str(first[kind, f] % 3)
            if owner is not None and f - last > 9:
                want.append((kind, owner, start, last + 1))
                owner = None
            if now == owner:
                last, other, count = f, None, 0
                continue
            other, count = now, count + 1 if now == other else 1
            if count == 3:
                if owner is not None:
                    want.append((kind, owner, start, last + 1))
                owner, start, last, other, count = now, f - 2, f, None, 0
        if owner is not None:
            want.append((kind, owner, start, last + 1))
    assert sorted(run("control_spans").itertuples(index=False, name=None)) == sorted(want)


def test_slot_matching(run, obs):
    slots = sorted((r.track, r.event_id, r.frame) for r in obs[obs.kind == "view"].itertuples())
    taken, want = set(), []
    for r in sorted(obs[obs.kind == "purchase"].itertuples(), key=lambda r: (r.frame, r.event_id)):
        free = [(abs(f - r.frame), s) for t, s, f in slots if t == r.track and s not in taken and abs(f - r.frame) <= 900]
        if free:
            taken.add(min(free)[1])
            want.append((r.track, r.event_id, min(free)[1]))
    assert sorted(run("slot_matching").itertuples(index=False, name=None)) == sorted(want)


def test_track_assignment(run, obs):
    groups = defaultdict(dict)
    for a in obs[obs.kind == "view"].itertuples():
        for b in obs[(obs.kind == "click") & (obs.track == a.track)].itertuples():
            cost = abs(a.value - b.value) + abs(a.frame - b.frame) / 100
            if a.frame // 2000 == b.frame // 2000 and cost < 60:
                groups[a.track, a.frame // 2000][a.event_id, b.event_id] = cost
    got = defaultdict(list)
    for r in run("track_assignment").itertuples():
        got[r.track, r.part].append(((r.row, r.col), r.cost))
    assert set(got) == set(groups)
    small = 0
    for key, cost in groups.items():
        pairs = [p for p, _ in got[key]]
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert all(math.isclose(cost[p], c) for p, c in got[key])
        rows, cols = sorted({r for r, _ in cost}), sorted({c for _, c in cost})
        if min(len(rows), len(cols)) > 4 or max(len(rows), len(cols)) > 7:
            continue
        small += 1
        few, many, flip = (rows, cols, False) if len(rows) <= len(cols) else (cols, rows, True)
        best = (0, 0.0)
        for order in itertools.permutations(many, len(few)):
            c = [cost[(y, x) if flip else (x, y)] for x, y in zip(few, order, strict=True) if ((y, x) if flip else (x, y)) in cost]
            best = max(best, (len(c), -sum(c)))
        assert len(pairs) == best[0] and math.isclose(sum(c for _, c in got[key]), -best[1], abs_tol=1e-6)
    assert small > 20


def test_smoothed_states(run, obs):
    want = {}
    for _, g in obs.sort_values("event_id").groupby("track"):
        kinds = g["kind"].tolist()
        for i, e in enumerate(g["event_id"]):
            near = Counter(kinds[max(0, i - 2) : i + 3])
            top = [k for k, n in near.items() if n >= 3]
            want[e] = top[0] if top else kinds[i]
    assert dict(run("smoothed_states").itertuples(index=False, name=None)) == want


def test_filtered_ball(run, spark):
    got = run("filtered_ball").set_index(["track", "frame"])
    for track, g in ledger._positions(spark, DATA).toPandas().sort_values("frame").groupby("segment"):
        place, speed, missed = None, np.zeros(3), 0
        for r in g.itertuples():
            z = np.array([r.x, r.y, r.z])
            ahead = None if place is None else place + speed
            row = got.loc[(track, r.frame)]
            if ahead is None or np.linalg.norm(z - ahead) <= 2.5:
                new = z if ahead is None else 0.6 * z + 0.4 * ahead
                speed = speed if ahead is None else 0.65 * speed + 0.35 * (new - place)
                place, missed = new, 0
            else:
                missed += 1
                place, speed = (ahead, 0.92 * speed) if missed <= 6 else (None, np.zeros(3))
            assert bool(row["predicted"]) == (missed > 0 and place is not None)
            assert (place is None and math.isnan(row["x"])) or np.allclose(row[["x", "y", "z"]].to_numpy(float), place)


def test_followed_boxes(run, spark):
    d = views.detections(spark, DATA).toPandas()
    d["x"], d["y"] = d["box"].map(lambda b: (b["x1"] + b["x2"]) / 2), d["box"].map(lambda b: (b["y1"] + b["y2"]) / 2)
    want, last, fresh = {}, defaultdict(dict), Counter()
    for image, g in d.sort_values("det").groupby("image"):
        s = image // 500
        near = sorted((math.hypot(r.x - x, r.y - y), r.det, t) for r in g.itertuples() for t, (f, x, y) in last[s].items() if image - f <= 3)
        mine = {}
        for far, det, t in near:
            if far < 8 and det not in mine:
                mine[det] = t
        for r in g.itertuples():
            if r.det not in mine:
                mine[r.det] = fresh[s]
                fresh[s] += 1
        for r in g.itertuples():
            last[s][mine[r.det]] = (image, r.x, r.y)
            want[image, r.det] = mine[r.det]
    assert {(r.frame, r.det): r.track for r in run("followed_boxes").itertuples()} == want


def test_smoothed_trajectory_and_outliers_of_observations(run, spark):
    got = run("smoothed_trajectory")
    bad = run("trajectory_outliers").sort_values(["segment", "frame"])
    for s, g in ledger._positions(spark, DATA).toPandas().sort_values("frame").groupby("segment"):
        f, p = g["frame"].to_numpy(), g[["x", "y", "z"]].to_numpy(float)
        assert bad[bad.segment == s]["outlier"].tolist() == plain_outliers(f, p, np.full(len(f), 3)).tolist()
        mine = got[got.segment == s].sort_values("frame")
        assert mine["frame"].tolist() == list(range(f[0], f[-1] + 1)) and mine[mine.observed]["frame"].tolist() == f.tolist()
        holes = mine[mine.filled]["frame"].to_numpy()
        runs = np.split(f, np.flatnonzero(np.diff(f) > 1) + 1)
        short = {x for a, b in itertools.pairwise(runs) if b[0] - a[-1] - 1 <= 24 for x in range(a[-1] + 1, b[0])}
        assert set(holes) <= short
        assert statistics.median(np.abs(mine[mine.observed]["sx"].to_numpy() - p[:, 0])) < 1


def test_stratified_frames(run, spark):
    rows = sampling.pictures(spark, DATA).toPandas()
    want = set()
    for (kind, track), g in rows.groupby(["kind", "track"]):
        ranked = sorted(((r.score, r.frame, r.view, r.begin, r.last) for r in g.itertuples()), reverse=True)
        count = Counter()
        for x in ranked:
            count[x[2]] += 1
        view = max(count, key=count.get)
        mine = [x for x in ranked if x[2] == view]
        width = max(1, (mine[0][4] - mine[0][3] + 1) // 6)
        best = [next((x for x in mine if min(5, (x[1] - x[3]) // width) == b), None) for b in range(6)]
        best = [x for x in best if x]
        taken = []
        for x in best + [x for x in mine if x not in best]:
            if len(taken) < 6 and all(abs(x[1] - y) >= 120 for y in taken):
                taken.append(x[1])
        want |= {(kind, track, view, n, f) for n, f in enumerate(taken, 1)}
    assert {(r.kind, r.track, r.view, r.rank, r.frame) for r in run("stratified_frames").itertuples()} == want and len(want) > 50


def test_compared_runs(run, spark):
    old, new = (x.toPandas() for x in sampling.two_runs(spark, DATA))
    want = set()
    for g in old["group"].unique():
        free = sorted((r.at, str(r.after)) for r in new[new.group == g].itertuples())
        for at, name in sorted((r.at, str(r.before)) for r in old[old.group == g].itertuples()):
            best = min(free, key=lambda x: abs(x[0] - at), default=None)
            if best and abs(best[0] - at) <= 30:
                free.remove(best)
                want.add((g, name, best[1], abs(best[0] - at), "matched"))
            else:
                want.add((g, name, None, None, "lost"))
        want |= {(g, None, name, None, "new") for _, name in free}
    plain = lambda x: None if x is None or x != x else x
    got = [tuple(map(plain, r)) for r in run("compared_runs").itertuples(index=False, name=None)]
    assert set(got) == want and len(got) == len(want) and {x[4] for x in want} == {"matched", "lost", "new"}


def test_tracked_ball(run, spark):
    got = run("tracked_ball").set_index(["view", "frame"])
    switched = 0
    for view, g in tracks.ball_candidates(spark, DATA).toPandas().sort_values("frame").groupby("view"):
        last, v, missed, rest = None, (0.0, 0.0), 0, 0
        for r in g.itertuples():
            balls = list(zip(r.xs, r.ys, r.scores, r.sizes, r.oranges, strict=True))
            good = lambda b: b[2] + 0.95 * b[4] + 0.25 * min(1, b[3] / 80)
            pick, swap = max(balls, key=good), False
            if last is not None:
                ahead = lambda b: math.hypot(b[0] - last[0] - v[0], b[1] - last[1] - v[1])  # noqa: B023, E731
                away = lambda b: math.hypot(b[0] - last[0], b[1] - last[1])  # noqa: B023, E731
                gate = min(520, 240 + 0.75 * math.hypot(*v) + 45 * min(missed, 3))
                near = [b for b in balls if ahead(b) <= gate and away(b) <= 520 and (away(b) <= 240 or good(b) >= 0.3)]
                best, pick = pick, min(near, key=lambda b: ahead(b) + 0.35 * away(b) - 70 * b[2] - 170 * b[4] - 0.3 * b[3], default=None)
                if pick is not None and rest >= 8 and best is not pick and best[4] >= 0.08 and away(best) <= 240 and good(best) >= good(pick) + 0.25:
                    pick, swap = best, True
            row = got.loc[(view, r.frame)]
            if pick is None:
                missed += 1
                assert row["missed"] == missed and math.isnan(row["x"])
                if missed > 12:
                    last, v, rest = None, (0.0, 0.0), 0
                continue
            moved = (pick[0] - last[0], pick[1] - last[1]) if last else None
            v = (0.65 * v[0] + 0.35 * moved[0], 0.65 * v[1] + 0.35 * moved[1]) if moved else (0.0, 0.0)
            rest = rest + 1 if moved and math.hypot(*moved) < 4 else 0
            last, missed, switched = pick[:2], 0, switched + swap
            assert (row["x"], row["y"], row["missed"], row["switched"]) == (*pick[:2], 0, swap)
    assert len(got) > 100
