"""Actions from a reconstructed trajectory: possession with catches and releases, flights named as shots, layups,
follow-ups and passes, makes and misses, rebounds, low passes.

A segment is one recording and one grouped call over its frames, since the rules read what came before. Positions are
metres, z up. What only depends on a frame or on its neighbours (nearest hands, speeds, ends of arcs) is worked out by
arrays first; only possession and the list of flights run in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summaries import hand_point

RIM = 3.05


@dataclass(frozen=True)
class ActionRules:
    """Metres, metres a second, seconds and frames."""

    hold: float = 0.45
    release: float = 0.6
    catch: float = 0.5
    handle: float = 1.2
    switch_frames: int = 5
    keep_frames: int = 30
    #: A ball that runs low beside a player is dribbled, whatever its state.
    low_dribble: float = 1.2
    dribble_speed: float = 0.5
    dribble_frames: int = 5
    #: Arcs: height of a launch, height of a landing, frames without a ball, hands that hold the ball, slow and low.
    launch: float = 1.8
    land: float = 1.2
    hole: int = 8
    held: float = 0.9
    slow: float = 2.0
    #: Flights go on backward below the first height and forward above the second.
    rise: float = 1.4
    stay: float = 1.9
    merge_frames: int = 5
    covered: float = 0.6
    least_seconds: float = 0.3
    probe_frames: int = 8
    #: Shots.
    near_hoop: float = 2.0
    near_rim: float = 1.2
    approach: float = 0.15
    miss: float = 0.7
    high_arc: float = 3.5
    high_miss: float = 1.6
    shot_apex: float = 2.0
    rim_apex: float = 2.9
    three: float = 6.54
    jolt: float = 0.8
    layup_release: float = 1.5
    layup_speed: float = 2.5
    layup_apex: float = 1.5
    layup_reach: float = 1.6
    pass_least: float = 1.5
    follow_release: float = 2.0
    follow_seconds: float = 4.0
    follow_frames: int = 90
    rebound_reach: float = 2.0
    rebound_frames: int = 40
    #: Makes: reach at the rim's height, over the rim, and while falling through; frames after the flight.
    make: float = 0.3
    over: float = 0.7
    through: float = 0.5
    make_frames: int = 40
    #: Low passes.
    low_height: float = 1.7
    low_speed: float = 3.0
    low_release: float = 0.95
    low_catch: float = 0.9
    low_frames: int = 60


@dataclass
class Action:
    type: str
    frame: int
    end: int
    actor: str | None = None
    receiver: str | None = None
    more: dict[str, Any] = field(default_factory=dict)


def _apart(a: np.ndarray | None, b: np.ndarray | None) -> float:
    return float("inf") if a is None or b is None else float(np.linalg.norm(a - b))


class Possession:
    """Who handles the ball: one step for each frame, the same for a whole segment and for a stream.

    ``step`` takes the frame's state, ball (or None), speed (or None) and hands by player, and returns the actions that
    the frame brings; ``owner`` is the handler after it.
    """

    def __init__(self, rules: ActionRules = ActionRules(), saved: dict | None = None) -> None:
        self.rules, saved = rules, saved or {}
        self.owner, self.unseen = saved.get("owner"), saved.get("unseen", 0)
        self.candidate, self.count, self.dribbler = saved.get("candidate"), saved.get("count", 0), saved.get("dribbler")
        #: Distances by player of the last frames with hands, states of the last frames, hands of the last frame.
        self.near = deque(saved.get("near", []), 3)
        self.states = deque(saved.get("states", []), 10)
        self.hands = {k: np.array(v) for k, v in saved["hands"].items()} if saved.get("hands") else None
        #: Catches (frame, player) that the ball has not stayed for yet, and catches made (frame, player).
        self.waiting = [tuple(x) for x in saved.get("waiting", [])]
        self.caught = {tuple(x) for x in saved.get("caught", [])}

    def saved(self) -> dict:
        oldest = min((f for f, _ in self.waiting), default=None)
        return {
            "owner": self.owner, "unseen": self.unseen, "candidate": self.candidate, "count": self.count, "dribbler": self.dribbler, "near": list(self.near),
            "states": list(self.states), "hands": self.hands and {k: v.tolist() for k, v in self.hands.items()}, "waiting": self.waiting,
            "caught": sorted(x for x in self.caught if oldest is not None and x[0] >= oldest),
        }

    def _came(self, player: str) -> bool:
        """Whether the ball was out of the player's hands in all of the last frames; there has to be one."""
        return bool(self.near) and min(d.get(player, float("inf")) for d in self.near) > self.rules.hold

    def _catch(self, frame: int, player: str) -> Action:
        self.caught.add((frame, player))
        return Action("catch", frame, frame, player)

    def _take(self, player: str) -> None:
        self.owner, self.unseen = player, 0

    def _stands(self, player: str | None) -> int:
        """Frames in a row for which ``player`` is the candidate."""
        self.count = self.count + 1 if player == self.candidate else 1
        self.candidate = player
        return self.count

    def _hand_over(self, frame: int, player: str) -> list[Action]:
        if "flight" in self.states:
            return []
        return [Action("pass", frame, frame, self.owner, player, {"handoff": True})]

    def _held(self, frame: int, player: str) -> list[Action]:
        out = []
        if self.owner != player and self._came(player):
            out.append(self._catch(frame, player))
            if self.owner is not None:
                out += self._hand_over(frame, player)
        self._take(player)
        return out

    def _dribbled(self, frame: int, player: str) -> list[Action]:
        if self._stands(player) < self.rules.switch_frames:
            return []
        out = [self._catch(frame, player)] if self.owner not in (None, player) else []
        self._take(player)
        return out

    def _flies(self, frame: int, ball: np.ndarray | None, hands: dict[str, np.ndarray], player: str | None, off: float) -> list[Action]:
        self.candidate, self.count = None, 0
        out = []
        own = hands.get(self.owner)
        # A ball that is not seen has not left a hand that is.
        if self.owner is not None and (own is None or (ball is not None and _apart(own, ball) > self.rules.release)):
            out.append(Action("release", frame, frame, self.owner))
            self.owner = None
        if player is not None and off <= self.rules.catch and self.hands is not None and _apart(self.hands.get(player), ball) > self.rules.catch + 0.1:
            self.waiting.append((frame, player))
        return out

    def _loose(self, frame: int, player: str | None, low: bool) -> list[Action]:
        out = []
        if not low:
            self.candidate, self.count = None, 0
            if self.dribbler is not None:
                out.append(Action("dribble_end", frame, frame, self.dribbler))
                self.dribbler = None
            self.unseen += 1
            if self.unseen > self.rules.keep_frames:
                self.owner = None
            return out
        if self._stands(player) >= self.rules.dribble_frames:
            if self.dribbler is None:
                out.append(Action("dribble_start", frame, frame, player, None, {"fallback": True}))
                self.dribbler = player
            if self.owner != player and (not self.near or self._came(player)):
                out += self._hand_over(frame, player)
            self._take(player)
        return out

    def _confirm(self, frame: int, ball: np.ndarray | None, hands: dict[str, np.ndarray]) -> list[Action]:
        """Catches of two frames ago or more that the ball has stayed for; the others go on waiting."""
        out, still = [], []
        for since, player in self.waiting:
            stayed = frame >= since + 2 and _apart(hands.get(player), ball) <= 1.2 * self.rules.catch
            if stayed and not any((f, player) in self.caught for f in range(since, since + 3)):
                out.append(self._catch(since, player))
                self._take(player)
            else:
                still.append((since, player))
        self.waiting = still
        return out

    def step(self, frame: int, state: str, ball: np.ndarray | None, speed: float | None, hands: dict[str, np.ndarray]) -> list[Action]:
        r = self.rules
        player, off = None, float("inf")
        if ball is not None:
            for who, hand in hands.items():
                if _apart(hand, ball) < off:
                    player, off = who, _apart(hand, ball)
        if state == "held" and off <= r.hold:
            out = self._held(frame, player)
        elif state == "dribble" and off <= r.handle:
            out = self._dribbled(frame, player)
        elif state == "flight":
            out = self._flies(frame, ball, hands, player, off)
        else:
            low = state in ("unknown", "ground") and off <= r.handle and ball[2] < r.low_dribble and (speed or 0.0) > r.dribble_speed
            out = self._loose(frame, player, low)
        out += self._confirm(frame, ball, hands)
        self.states.append(state)
        self.hands = hands or None
        if hands:
            self.near.append({k: _apart(h, ball) for k, h in hands.items()} if ball is not None else {})
        return out


class Scene:
    """A segment by place in its unbroken grid of frames: ball, states, and distances of all hands by array."""

    def __init__(self, rows: pd.DataFrame, fps: float) -> None:
        f = rows["frame"].to_numpy(int)
        self.first, self.fps = int(f.min()), fps
        n = int(f.max()) - self.first + 1
        at = f - self.first
        self.p, self.state = np.full((n, 3), np.nan), np.full(n, "unknown", object)
        self.p[at] = rows[["x", "y", "z"]].to_numpy(float)
        self.state[at] = rows["state"].to_numpy()
        self.speed = np.full(n, np.nan)
        self.speed[at] = np.linalg.norm(rows[["vx", "vy", "vz"]].to_numpy(float), axis=1)
        self.seen = np.isfinite(self.p).all(axis=1)
        self.hands: list[dict[str, np.ndarray]] = [{} for _ in range(n)]
        self.feet: list[dict[str, np.ndarray]] = [{} for _ in range(n)]
        for i, people in zip(at, rows["people"], strict=True):
            for x in people if people is not None else ():
                if x["hand"] is not None:
                    self.hands[i][x["player"]] = np.array([x["hand"][c] for c in "xyz"])
                if x["foot"] is not None:
                    self.feet[i][x["player"]] = np.array([x["foot"][c] for c in "xy"])
        self.names = sorted({k for h in self.hands for k in h})
        place = {k: j for j, k in enumerate(self.names)}
        self.off = np.full((n, max(1, len(self.names))), np.inf)
        for i, h in enumerate(self.hands):
            for k, x in h.items():
                self.off[i, place[k]] = _apart(x, self.p[i]) if self.seen[i] else np.inf
        self.nearest, self.reach = self.off.argmin(axis=1), self.off.min(axis=1)
        #: Speed from the place before, where both are seen.
        self.moved = np.full(n, np.nan)
        self.moved[1:] = np.linalg.norm(np.diff(self.p, axis=0), axis=1) * fps

    def __len__(self) -> int:
        return len(self.p)

    def player(self, i: int) -> str | None:
        return self.names[self.nearest[i]] if np.isfinite(self.reach[i]) else None

    def possession(self, rules: ActionRules) -> tuple[list[Action], list[str | None]]:
        machine, out, owner = Possession(rules), [], []
        for i in range(len(self)):
            ball = self.p[i] if self.seen[i] else None
            out += machine.step(self.first + i, self.state[i], ball, None if np.isnan(self.speed[i]) else self.speed[i], self.hands[i])
            owner.append(machine.owner)
        return out, owner


def _walk(halts: np.ndarray, start: int, step: int) -> int:
    """From ``start`` on, by ``step``, to the first place that halts; the last place halts in any case."""
    there = np.flatnonzero(halts)
    if step < 0:
        k = bisect_left(there, start + 1) - 1
        return int(there[k]) if k >= 0 else 0
    k = bisect_left(there, start)
    return int(there[k]) if k < len(there) else len(halts) - 1


def _before(x: np.ndarray, empty: float | bool) -> np.ndarray:
    return np.concatenate([np.full(1, empty, x.dtype), x[:-1]])


def launch_arcs(s: Scene, r: ActionRules = ActionRules()) -> list[tuple[int, int]]:
    """Places [release, end] of a ball that rises over the launch height until it is caught, lands or is lost.

    The release is walked back to a ball in the hands, or low and slow or near a hand.
    """
    z = np.where(s.seen, s.p[:, 2], np.nan)
    caught = (s.reach <= r.catch) & _before(s.reach <= r.catch, False)
    with np.errstate(invalid="ignore"):
        up, down = z >= r.launch, (z < r.launch) & (caught | (z < r.land))
    seen_at = np.maximum.accumulate(np.where(s.seen, np.arange(len(s)), -1))
    lost = np.arange(len(s)) - seen_at > r.hole
    events = np.flatnonzero(up), np.flatnonzero(down | lost)
    arcs, i = [], 0
    while (k := bisect_left(events[0], i)) < len(events[0]):
        start = int(events[0][k])
        e = bisect_left(events[1], start + 1)
        end = int(events[1][e]) if e < len(events[1]) else len(s)
        last = int(seen_at[min(end, len(s) - 1)])
        arcs.append((start, last))
        i = end + 1
    hold = s.reach <= r.held
    with np.errstate(invalid="ignore"):
        quiet = (_before(z, np.nan) < r.land) & ((s.moved < r.slow) | (_before(s.reach, np.inf) <= r.handle))
    two_held = _before(hold & _before(hold, False), False)
    halts = ~s.seen | ~_before(s.seen, False) | two_held | quiet
    return [(_walk(halts, a, -1), b) for a, b in arcs]


def extended(s: Scene, flights: Iterable[tuple[int, int]], r: ActionRules = ActionRules()) -> list[tuple[int, int]]:
    """Flights carried on at both ends while the ball moves: back while it is low and in no hand, on while it is high.

    What then meets the flight before it in the list is joined to it, in the order of the list.
    """
    z = s.p[:, 2]
    with np.errstate(invalid="ignore"):
        fast = s.moved > r.slow
        back = ~s.seen | ~_before(s.seen, False) | (_before(z, np.nan) > r.rise) | (s.moved < r.slow) | (_before(s.reach, np.inf) <= r.held)
        goes = s.seen & _before(s.seen, False) & (z > r.stay) & fast
    # A flight goes on to the next place, but never to the last one of all.
    on = ~np.append(goes[1:], False)
    on[-2:] = True
    out: list[tuple[int, int]] = []
    for a, b in flights:
        a, b = _walk(back, a, -1), _walk(on, b, 1)
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def low_passes(s: Scene, r: ActionRules = ActionRules()) -> list[Action]:
    """Balls that leave a hand fast and low and settle near another player's hand."""
    with np.errstate(invalid="ignore"):
        steps = s.seen & _before(s.seen, False)
        high, slow = s.p[:, 2] > r.low_height, s.moved < 0.6 * r.low_speed
        begins = np.flatnonzero(steps & ~high & (s.moved >= r.low_speed) & (s.state != "held"))
        ends = np.flatnonzero(~s.seen | high | slow)
    out, i = [], 0
    while (k := bisect_left(begins, i)) < len(begins):
        a = int(begins[k])
        e = bisect_left(ends, a + 1)
        b = min(int(ends[e]) if e < len(ends) else len(s), a + r.low_frames + 1)
        i = b + 1
        if b >= len(s) or not s.seen[b] or high[b] or not slow[b] or s.reach[b] > r.low_catch or s.reach[a - 1] > r.low_release:
            continue
        if s.player(a - 1) != s.player(b):
            out.append(Action("pass", s.first + a, s.first + b, s.player(a - 1), s.player(b), {"low": True}))
    return out


def shot_result(p: np.ndarray, hoop: np.ndarray, r: ActionRules = ActionRules()) -> str:
    """make or miss of the points seen from the flight on.

    A make falls through the rim's height within its reach, or, last seen over the rim, keeps falling through the
    opening.
    """
    z, flat = p[:, 2], np.linalg.norm(p[:, :2] - hoop[:2], axis=1)
    falls = np.flatnonzero((z[:-1] > RIM) & (z[1:] <= RIM) & (z[:-1] - z[1:] > 0.05))
    share = ((z[falls] - RIM) / np.maximum(z[falls] - z[falls + 1], 1e-9))[:, None]
    at = p[falls, :2] + share * (p[falls + 1, :2] - p[falls, :2])
    if (np.linalg.norm(at - hoop[:2], axis=1) <= r.make).any():
        return "make"
    over = np.flatnonzero((z >= RIM - 0.02) & (flat <= r.over))
    if not len(over):
        return "miss"
    after = slice(int(over[-1]) + 1, None)
    out_of_band = (z[after] < 2.5) | (z[after] > RIM + 0.05) | (np.diff(z[after], prepend=np.inf) > 0.01)
    n = int(np.argmax(out_of_band)) if out_of_band.any() else len(out_of_band)
    return "make" if n and (flat[after][:n] <= r.through).all() else "miss"


def approach_speed(s: Scene, player: str, i: int, hoop: np.ndarray, span: int = 10) -> float | None:
    """How fast the player came nearer to the hoop over the frames before: farthest place against the last."""
    back = max(i - span, -s.first, 0) if s.first + i >= 3 else i
    away = [float(np.linalg.norm(s.feet[k][player] - hoop[:2])) for k in range(back, i + 1) if player in s.feet[k]]
    seconds = min(span, s.first + i) / s.fps
    if s.first + i < 3 or player not in s.feet[i] or seconds <= 0:
        return None
    return (max(away) - away[-1]) / seconds


@dataclass
class FlightView:
    """What the rules ask of one flight: its seen points, who let the ball go and who was nearest to it after."""

    start: int
    end: int
    at: np.ndarray
    points: np.ndarray
    seconds: float
    thrower: str | None
    catcher: str | None
    caught_at: int
    caught_off: float
    hoop: np.ndarray

    def __post_init__(self) -> None:
        away = np.linalg.norm(self.points[:, :2] - self.hoop[:2], axis=1)
        self.apex, self.nearest, self.released = float(self.points[:, 2].max()), float(away.min()), float(away[0])
        self.turn = int(away.argmin())
        self.span = float(np.linalg.norm(self.points[-1, :2] - self.points[0, :2]))


def _thrower(s: Scene, a: int, owner: list[str | None], r: ActionRules) -> str | None:
    """The handler at the start if the hand is near the ball; else the first hand near it in the frames before."""
    known = (owner[a - 1] if a else None) or owner[a]
    hand = s.hands[a].get(known, s.hands[a - 1].get(known) if a else None)
    if known is not None and hand is not None and not (s.seen[a] and _apart(hand, s.p[a]) > 2.5 * r.release):
        return known
    near = range(max(a - r.probe_frames, 0), a + 1)
    return next((s.player(i) for i in near if s.seen[i] and s.reach[i] <= 2.5 * r.release and s.player(i) is not None), None)


def _view(s: Scene, a: int, b: int, owner: list[str | None], hoop: np.ndarray, r: ActionRules) -> FlightView | None:
    at = a + np.flatnonzero(s.seen[a : b + 1])
    seconds = (b - a) / s.fps
    if len(at) < 2 or seconds < r.least_seconds:
        return None
    thrower = _thrower(s, a, owner, r)
    mine = np.array([s.player(i) == thrower for i in at])
    off = np.where(mine, np.inf, s.reach[at])
    best = int(off.argmin())
    caught = bool(np.isfinite(off[best]))
    return FlightView(a, b, at, s.p[at], seconds, thrower, s.player(int(at[best])) if caught else None, int(at[best]), float(off[best]), hoop)


def _follows(v: FlightView, done: list[Action], s: Scene, r: ActionRules) -> str | None:
    """The player of a follow-up: a short arc at the rim soon after a missed shot."""
    gained = (x.actor for x in reversed(done) if x.type in ("catch", "rebound") and x.end <= s.first + v.start)
    player = v.thrower if v.thrower is not None else next(gained, None)
    if player is None or v.apex < r.shot_apex or v.released > r.follow_release or v.seconds > r.follow_seconds:
        return None
    last = next((x for x in reversed(done) if x.type in ("shoot", "layup") and x.end < s.first + v.start), None)
    soon = last is not None and last.more.get("result") == "miss" and s.first + v.start - last.end <= r.follow_frames
    return player if soon else None


def _is_shot(v: FlightView, r: ActionRules) -> bool:
    """A thrown arc toward the hoop that comes near enough; a caught one only if high or from far away."""
    far = v.released >= r.three
    toward = v.turn >= max(2, int(r.approach * len(v.at)))
    close = v.nearest <= (r.high_miss if v.apex >= r.high_arc else r.miss)
    caught = v.catcher is not None and v.caught_off <= r.catch
    return v.thrower is not None and (v.nearest <= r.near_rim or far) and toward and close and v.apex > r.shot_apex and (v.apex >= r.rim_apex or far or not caught)


def _rebound(v: FlightView, s: Scene, r: ActionRules) -> Action | None:
    """The first grab of the falling ball in the air near the rim, by anyone but the shooter."""
    def grabbed(i: int) -> bool:
        return bool(s.p[i, 2] >= 0.8 and np.linalg.norm(s.p[i, :2] - v.hoop[:2]) <= r.rebound_reach)

    where = None
    if v.catcher is not None and v.caught_at >= v.end - 15 and v.caught_off <= 1.5 * r.catch and grabbed(v.caught_at):
        where = v.caught_at
    else:
        for i in range(v.end + 1, min(len(s), v.end + 1 + r.rebound_frames)):
            if s.seen[i] and s.p[i, 2] < 0.4:
                break
            if s.seen[i] and s.reach[i] <= 1.5 * r.catch and s.player(i) != v.thrower and grabbed(i):
                where = i
                break
    return None if where is None else Action("rebound", s.first + where, s.first + where, s.player(where), None, {"after": "shoot"})


def _named(v: FlightView, s: Scene, done: list[Action], r: ActionRules) -> list[Action]:
    """The actions of one flight: the first of follow-up, shot, pass and short layup that holds."""
    after = np.arange(v.end + 1, min(len(s), v.end + 1 + r.make_frames))
    span = np.concatenate([v.points, s.p[after[s.seen[after]]]])
    figures = {"apex": v.apex, "hoop_distance": v.nearest, "release_distance": v.released, "seconds": v.seconds}

    def made(kind: str, player: str | None, **more: Any) -> Action:
        return Action(kind, s.first + v.start, s.first + v.end, player, None, figures | {"result": shot_result(span, v.hoop, r)} | more)

    jolted = v.start > 0 and s.seen[v.start - 1] and s.seen[v.start] and abs(s.p[v.start, 2] - s.p[v.start - 1, 2]) > r.jolt
    if (player := _follows(v, done, s, r)) is not None:
        return [made("follow_up", player)]
    if not jolted and _is_shot(v, r):
        drive = approach_speed(s, v.thrower, v.start, v.hoop)
        layup = v.released <= r.layup_release and drive is not None and drive >= r.layup_speed
        back = np.arange(max(v.start - 6, 0), v.end + 1)
        far = np.linalg.norm(s.p[back[s.seen[back]], :2] - v.hoop[:2], axis=1).max() >= r.three
        shot = made("layup" if layup else "shoot", v.thrower, three=bool(far and not layup))
        grab = _rebound(v, s, r) if shot.more["result"] == "miss" else None
        return [*([grab] if grab else []), shot]
    if v.catcher is not None and v.caught_off <= 2 * r.catch and v.span > r.pass_least:
        return [Action("pass", s.first + v.start, s.first + v.end, v.thrower, v.catcher, {"apex": v.apex, "span": v.span, "seconds": v.seconds})]
    if v.nearest < r.near_hoop and v.thrower is not None and v.apex >= r.layup_apex and v.released <= r.layup_reach:
        return [made("layup", v.thrower)]
    return []


def merge_flights(spans: Iterable[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans in order of start, joined where at most ``gap`` frames lie between them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def segment_actions(rows: pd.DataFrame, flights: Iterable[tuple[int, int]], hoop: np.ndarray, fps: float, rules: ActionRules = ActionRules()) -> tuple[list[Action], list[str | None]]:
    """Actions of one segment by frame and type, and the handler of each frame.

    ``rows`` has frame, x, y, z, vx, vy, vz, state and people (list of player, hand, foot). Known flights come first,
    then launch arcs that they cover for less than a part. A jolt at the start of a flight is no shot.
    """
    s = Scene(rows, fps)
    done, owner = s.possession(rules)
    known = merge_flights(((a - s.first, b - s.first) for a, b in flights), rules.merge_frames)
    known += [
        (a, b) for a, b in launch_arcs(s, rules)
        if sum(max(0, min(b, y) - max(a, x) + 1) for x, y in known) < rules.covered * (b - a + 1)
    ]
    for a, b in extended(s, known, rules):
        if (view := _view(s, a, b, owner, hoop, rules)) is not None:
            done += _named(view, s, done, rules)
    done += low_passes(s, rules)
    return sorted(done, key=lambda x: (x.frame, x.type)), owner


def people_of(poses: DataFrame) -> DataFrame:
    """segment, frame, people (array of player, hand, foot) of poses (segment, frame, player, keypoints: array of x, y, z)."""
    def joint(i: int) -> Column:
        p = F.get(F.col("keypoints"), F.lit(i))
        whole = F.lit(True)
        for c in "xyz":
            whole = whole & p[c].isNotNull() & ~F.isnan(p[c])
        return F.when(whole, F.struct(p["x"].alias("x"), p["y"].alias("y")))

    one = F.struct(F.col("player").cast("string").alias("player"), hand_point(F.col("keypoints")).alias("hand"), F.coalesce(joint(11), joint(0)).alias("foot"))
    return poses.where("player is not null").groupBy("segment", "frame").agg(F.sort_array(F.collect_list(one)).alias("people"))


ACTION = "type string, frame long, end long, actor string, receiver string, result string, three boolean, apex double, hoop_distance double, release_distance double, span double, seconds double, handoff boolean, low boolean, fallback boolean"


def actions(balls: DataFrame, flights: DataFrame, poses: DataFrame, hoop: tuple[float, float], fps: float, rules: ActionRules = ActionRules()) -> DataFrame:
    """Actions of every segment, one row each.

    ``balls`` has segment, frame, x, y, z, vx, vy, vz, state (``trajectory.reconstruct``), ``flights`` segment, start,
    end, kind (those of kind flight count), ``poses`` segment, frame, player, keypoints (x, y, z in metres). The hoop is
    given by its centre on the floor.
    """
    at, names = np.array([*hoop, RIM]), [c.split()[0] for c in ACTION.split(", ")]
    rows = balls.select("segment", "frame", "x", "y", "z", "vx", "vy", "vz", "state").join(people_of(poses), ["segment", "frame"], "left")

    def run(r: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=["segment", *names])
        spans = zip(known["start"].tolist(), known["end"].tolist(), strict=True)
        found, _ = segment_actions(r.sort_values("frame"), spans, at, fps, rules)
        table = [{"segment": r["segment"].iloc[0], "type": x.type, "frame": x.frame, "end": x.end, "actor": x.actor, "receiver": x.receiver} | x.more for x in found]
        return pd.DataFrame(table, columns=["segment", *names], dtype=object)

    spans = flights.where("kind = 'flight'").select("segment", "start", "end")
    return rows.groupBy("segment").cogroup(spans.groupBy("segment")).applyInPandas(run, f"segment {dict(balls.dtypes)['segment']}, {ACTION}")
