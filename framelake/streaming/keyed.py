"""Machines over frames of a key, the same in batch and as a stream with keyed state, timers and eviction.

A machine takes all rows of one frame at a time, frames in order, and can be saved between any two frames as plain
values (``saved``) and made again from them (``saved=``). ``run_batch`` feeds it the sorted frames of each key.
``run_stream`` keeps it in the state store: rows of a frame may come in several micro-batches and out of order; the
newest frame of a key is held back until a later one comes or the key was idle for some time. Then it is finished and the
key's state is evicted. Rows of frames that are finished already are late and dropped, and of equal rows of a frame
(by ``ROW``, where a machine has it) the first counts. So a stream gives the same rows as a batch without its late rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.actions import ActionRules, Possession
from framelake.operators.identity import Roster

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(x: Any) -> Any:
    """Values as JSON keeps them."""
    if isinstance(x, np.ndarray | list | tuple):
        return [_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, np.generic):
        x = x.item()
    return None if isinstance(x, float) and x != x else x


class PossessionMachine:
    """Handler and possession actions of each frame, from state, x, y, z, speed and people (``actions.people_of``)."""

    IN, ROW = ("state", "x", "y", "z", "speed", "people"), ()
    OUT = "owner string, actions array<struct<type:string,frame:long,actor:string,receiver:string>>"

    def __init__(self, saved: dict | None = None, **rules: float) -> None:
        self.machine = Possession(ActionRules(**rules), saved)

    def saved(self) -> dict:
        return self.machine.saved()

    def take(self, frame: int, rows: list[dict]) -> list[tuple]:
        r = rows[0]
        ball = np.array([np.nan if r[c] is None else r[c] for c in "xyz"], float)
        hands = {p["player"]: np.array([p["hand"][c] for c in "xyz"]) for p in r["people"] or () if p["hand"] is not None}
        found = self.machine.step(frame, r["state"], ball if np.isfinite(ball).all() else None, r["speed"], hands)
        shown = [{k: v for k, v in asdict(a).items() if k in ("type", "frame", "actor", "receiver")} for a in found]
        return [(self.machine.owner, shown)]


class RosterMachine:
    """Track of each detection (det, x, y, appearance) of a frame, and whether the track was lost before."""

    IN, ROW = ("det", "x", "y", "appearance"), ("det",)
    OUT = f"det long, {Roster.OUT}"

    def __init__(self, saved: dict | None = None, **settings: float) -> None:
        self.roster = Roster(**settings)
        if saved:
            self.roster.tracks = {int(k): {"place": np.array(v["place"]), "speed": np.array(v["speed"]), "seen": v["seen"], "looks": [np.array(x) for x in v["looks"]]} for k, v in saved.items()}

    def saved(self) -> dict:
        return {str(k): _plain(v) for k, v in self.roster.tracks.items()}

    def take(self, frame: int, rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r["det"])
        got = self.roster.step(frame, np.array([(r["x"], r["y"]) for r in rows], float), [np.array(r["appearance"], float) for r in rows])
        return [(r["det"], track, revived) for r, (track, revived) in zip(rows, got, strict=True)]


def _frames(rows: list[dict], kind: type) -> Iterator[tuple[int, list[dict]]]:
    """Rows by frame, in order of frames, without those that repeat a row."""
    held: dict[int, dict[tuple, dict]] = {}
    for r in rows:
        held.setdefault(int(r["frame"]), {}).setdefault(tuple(r[c] for c in kind.ROW), r)
    for frame in sorted(held):
        yield frame, list(held[frame].values())


def _names(kind: type) -> list[str]:
    return ["frame", *(part.split()[0].split(":")[0] for part in _columns(kind.OUT))]


def _columns(schema: str) -> list[str]:
    """Columns of a schema string; commas within brackets do not part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _table(key: tuple, keys: list[str], kind: type, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *x) for x in found], columns=[*keys, *_names(kind)], dtype=object)


def _schema(df: DataFrame, keys: list[str], kind: type) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"{k} {types[k]}" for k in keys], "frame long", kind.OUT])


def run_batch(df: DataFrame, keys: list[str], kind: type, **settings: float) -> DataFrame:
    """The machine over all frames of each key in order."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        machine = kind(**settings)
        plain = _plain(rows[["frame", *kind.IN]].to_dict("records"))
        return _table(key, keys, kind, [(f, *x) for f, now in _frames(plain, kind) for x in machine.take(f, now)])

    return df.select(*keys, "frame", *kind.IN).groupBy(*keys).applyInPandas(run, _schema(df, keys, kind))


class Keyed(StatefulProcessor):
    """A machine of one key in the state store, with the rows of the newest frame and a timer that runs while it is idle."""

    def __init__(self, keys: list[str], kind: type, idle_ms: int, settings: dict) -> None:
        self.keys, self.kind, self.idle_ms, self.settings = keys, kind, idle_ms, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "saved string")

    def _feed(self, saved: dict, frames: list[tuple[int, list[dict]]]) -> tuple[dict, list[tuple]]:
        machine, found = self.kind(saved=saved["machine"], **self.settings), []
        for frame, rows in frames:
            found += [(frame, *x) for x in machine.take(frame, rows)]
            saved["last"] = frame
        saved["machine"] = _plain(machine.saved())
        return saved, found

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"machine": None, "last": None, "held": []}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        saved = self._load()
        new = [r for batch in rows for r in _plain(batch[["frame", *self.kind.IN]].to_dict("records"))]
        fresh = saved["held"] + [r for r in new if saved["last"] is None or r["frame"] > saved["last"]]
        frames = list(_frames(fresh, self.kind))
        saved["held"] = frames[-1][1] if frames else []
        saved, found = self._feed(saved, frames[:-1])
        self.state.update((json.dumps(saved),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _table(key, self.keys, self.kind, found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        saved = self._load()
        _, found = self._feed(saved, list(_frames(saved["held"], self.kind)))
        self.state.clear()
        yield _table(key, self.keys, self.kind, found)

    def close(self) -> None:
        pass


def run_stream(df: DataFrame, keys: list[str], kind: type, idle_seconds: float = 600.0, **settings: float) -> DataFrame:
    """The machine over a stream; a key that had no rows for ``idle_seconds`` is finished and forgotten."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = df.select(*keys, "frame", *kind.IN).groupBy(*keys)
    processor = Keyed(keys, kind, int(idle_seconds * 1000), settings)
    return rows.transformWithStateInPandas(processor, _schema(df, keys, kind), "append", "ProcessingTime")
