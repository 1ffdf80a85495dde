"""Online filters over frames in order, for batch and for Structured Streaming.

Each filter is a class with ``state()`` and ``step(row)``; batch runs it over a sorted group, the stream keeps
its state between micro-batches by key. Event time is the frame; rows of one micro-batch are sorted by frame, and a
row that is not later than the last frame of its key is late and dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf, nan, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.events import Ownership


#: Pixels that a resting ball moves at most.
REST = 4.0


class BallFilter:
    """Alpha-beta filter of a 3-D ball: rejects jumps, holds a lost ball for a few frames, then forgets it."""

    OUT = "x double, y double, z double, predicted boolean"
    STATE = "position array<double>, velocity array<double>, missing long"
    IN = ("x", "y", "z")

    def __init__(self, state: tuple | None = None, alpha: float = 0.6, hold: int = 6, jump: float = 2.5) -> None:
        self.alpha, self.hold, self.jump = alpha, hold, jump
        position, velocity, self.missing = state or (None, [0.0] * 3, 0)
        self.position = None if position is None else np.array(position)
        self.velocity = np.array(velocity, float)

    def state(self) -> tuple:
        return (None if self.position is None else self.position.tolist(), self.velocity.tolist(), self.missing)

    def step(self, *measured: float | None) -> tuple:
        z = np.array([np.nan if v is None else v for v in measured], float)
        ahead = None if self.position is None else self.position + self.velocity
        good = np.isfinite(z).all() and (ahead is None or np.linalg.norm(z - ahead) <= self.jump)
        if good:
            new = z if ahead is None else self.alpha * z + (1 - self.alpha) * ahead
            if ahead is not None:
                self.velocity = 0.65 * self.velocity + 0.35 * (new - self.position)
            self.position, self.missing = new, 0
            return (*new.tolist(), False)
        self.missing += 1
        if ahead is None or self.missing > self.hold:
            self.position, self.velocity = None, np.zeros(3)
            return (None, None, None, False)
        self.velocity = self.velocity * 0.92
        self.position = ahead
        return (*ahead.tolist(), True)


class JointSmoother:
    """Exponential mean of every joint; a joint that is missing keeps its last place for a few frames."""

    OUT = "joints array<double>, held boolean"
    STATE = "joints array<double>, missing long"
    IN = ("joints",)

    def __init__(self, state: tuple | None = None, alpha: float = 0.5, hold: int = 5) -> None:
        self.alpha, self.hold = alpha, hold
        joints, self.missing = state or (None, 0)
        self.joints = None if joints is None else np.array(joints, float)

    def state(self) -> tuple:
        return (None if self.joints is None else self.joints.tolist(), self.missing)

    def step(self, joints: list | None) -> tuple:
        if joints is None:
            self.missing += 1
            if self.joints is None or self.missing > self.hold:
                return (None, True)
            return (self.joints.tolist(), True)
        now = np.array([np.nan if v is None else v for v in joints], float).reshape(-1, 3)
        if self.joints is not None and len(self.joints) == now.size:
            last = self.joints.reshape(-1, 3)
            here, there = np.isfinite(now).all(axis=1), np.isfinite(last).all(axis=1)
            both, only = here & there, ~here & there
            now[both] = self.alpha * now[both] + (1 - self.alpha) * last[both]
            if self.missing < self.hold:
                now[only] = last[only]
        self.joints, self.missing = now.reshape(-1), 0
        return (self.joints.tolist(), False)


class BallTracker:
    """One ball in one view, from the candidates of each frame: places, scores, sizes in pixels and shares of orange.

    Without a track the candidate of best quality begins one. Else a candidate is reachable if it lies within a gate
    around the predicted place, which widens with speed and while the ball is lost, and not too far from the last
    place; a far one needs ``least`` quality. Of these the nearest counts, where score, orange and size make up for
    distance. A ball that has not moved for ``still`` frames gives way to a near candidate of clearly better quality.
    """

    OUT = "x double, y double, missed long, switched boolean"
    STATE = "position array<double>, velocity array<double>, missed long, rested long"
    IN = ("xs", "ys", "scores", "sizes", "oranges")

    def __init__(self, state: tuple | None = None, far: float = 520.0, jump: float = 240.0, margin: float = 0.25, least: float = 0.30, lost: int = 12, still: int = 8) -> None:
        self.far, self.jump, self.margin, self.least, self.lost, self.still = far, jump, margin, least, lost, still
        position, velocity, self.missed, self.rested = state or (None, [0.0, 0.0], 0, 0)
        self.position = None if position is None else tuple(map(float, position))
        self.velocity = tuple(map(float, velocity))

    def state(self) -> tuple:
        return (None if self.position is None else list(self.position), list(self.velocity), self.missed, self.rested)

    def _miss(self) -> tuple:
        self.missed += 1
        if self.missed > self.lost:
            self.position, self.velocity, self.rested = None, (0.0, 0.0), 0
        return (None, None, self.missed, False)

    def step(self, xs: list | None, ys: list | None, scores: list | None, sizes: list | None, oranges: list | None) -> tuple:
        if xs is None or not len(xs):
            return self._miss()
        # A frame has a handful of candidates, for which plain numbers cost far less than arrays.
        at = [(_number(x, nan), _number(y, nan)) for x, y in zip(xs, ys, strict=True)]
        looks = [(_number(s, 0.0), _number(w, 0.0), _number(o, 0.0)) for s, w, o in zip(scores, sizes, oranges, strict=True)]
        quality = [s + 0.95 * o + 0.25 * (1.0 if w / 80.0 > 1.0 else w / 80.0) for s, w, o in looks]
        best, switched = _first_of_least([-q for q in quality]), False
        if self.position is None:
            taken = best
        else:
            (px, py), (vx, vy) = self.position, self.velocity
            gate = min(self.far, self.jump + 0.75 * sqrt(vx * vx + vy * vy) + 45.0 * min(self.missed, 3))
            nx, ny = px + vx, py + vy
            aways, costs, reached = [], [], False
            for (x, y), (s, w, o), q in zip(at, looks, quality, strict=True):
                ahead, away = sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)), sqrt((x - px) * (x - px) + (y - py) * (y - py))
                reachable = ahead <= gate and away <= self.far and (away <= self.jump or q >= self.least)
                reached |= reachable
                aways.append(away)
                costs.append(ahead + 0.35 * away - 70.0 * s - 170.0 * o - 0.30 * w if reachable else inf)
            if not reached:
                return self._miss()
            taken = _first_of_least(costs)
            better = best != taken and looks[best][2] >= 0.08 and aways[best] <= self.jump and quality[best] >= quality[taken] + self.margin
            if self.rested >= self.still and better:
                taken, switched = best, True
        new, self.missed = at[taken], 0
        if self.position is None:
            self.velocity, self.rested = (0.0, 0.0), 0
        else:
            mx, my = new[0] - self.position[0], new[1] - self.position[1]
            self.velocity = 0.65 * self.velocity[0] + 0.35 * mx, 0.65 * self.velocity[1] + 0.35 * my
            self.rested = self.rested + 1 if sqrt(mx * mx + my * my) < REST else 0
        self.position = new
        return (*new, 0, switched)


def _number(v: float | None, missing: float) -> float:
    return missing if v is None else float(v)


def _first_of_least(values: list[float]) -> int:
    """Place of the first value that is no number, else of the first of the least."""
    odd = [i for i, v in enumerate(values) if v != v]
    return odd[0] if odd else values.index(min(values))


class OwnerFilter:
    """Ownership with hysteresis as a filter: the current owner after each frame."""

    OUT = "control string, since long"
    STATE = "owner string, start long, seen long, candidate string, count long"
    IN = ("frame", "owner")

    def __init__(self, state: tuple | None = None, least: int = 3, longest: int = 9) -> None:
        self.machine = Ownership(least, longest, state)

    def state(self) -> tuple:
        return self.machine.state()

    def step(self, frame: int, owner: str | None) -> tuple:
        for _ in self.machine.step(frame, owner):
            pass
        return (self.machine.owner, self.machine.start if self.machine.owner is not None else None)


def _plain(v: object) -> object:
    if isinstance(v, np.ndarray):
        return v.tolist()
    return None if v is None or (isinstance(v, float) and v != v) else v


def _rows(filter_: object, kind: type, rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    named, cells = zip(*[rows[c].tolist() for c in (*keys, "frame")], strict=True), zip(*[map(_plain, rows[c].tolist()) for c in kind.IN], strict=True)
    out = [(*own, *filter_.step(*row)) for own, row in zip(named, cells, strict=True)]
    names = [c.split()[0] for c in kind.OUT.split(", ")]
    return pd.DataFrame(out, columns=[*keys, "frame", *names])


def _schema(df: DataFrame, keys: list[str], kind: type) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"{k} {types[k]}" for k in keys], "frame long", kind.OUT])


def run_batch(df: DataFrame, keys: list[str], kind: type, **settings: float) -> DataFrame:
    """The filter over all frames of each key in order; of repeated frames the first row counts, as in a stream."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(kind(**settings), kind, rows.sort_values("frame", kind="stable").drop_duplicates("frame"), keys)

    return df.groupBy(*keys).applyInPandas(run, _schema(df, keys, kind))


def stream_step(keys: list[str], kind: type, settings: dict) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = state.get if state.exists else None
        last = saved[0] if saved else None
        filter_ = kind(state=tuple(saved[1:]) if saved else None, **settings)
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        if last is not None:
            rows = rows[rows["frame"] > last]
        rows = rows.drop_duplicates("frame")
        if len(rows):
            out = _rows(filter_, kind, rows, keys)
            state.update((int(rows["frame"].max()), *filter_.state()))
            yield out

    return run


def run_stream(df: DataFrame, keys: list[str], kind: type, **settings: float) -> DataFrame:
    """The same filter over a stream; state is kept by key between micro-batches."""
    return df.groupBy(*keys).applyInPandasWithState(stream_step(keys, kind, settings), _schema(df, keys, kind), f"last long, {kind.STATE}", "append", GroupStateTimeout.NoTimeout)
