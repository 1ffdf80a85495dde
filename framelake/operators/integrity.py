"""Checks that a plan holds what it promises, as tables of the rows that break the promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role that does the deed in each kind of event.
POSITIVE_ROLES = {"shot": "shooter", "rebound": "rebounder", "steal": "stealer", "block": "blocker", "successful_drive": "driver", "assist_chain": "passer"}


def played_by(player: Column) -> Column:
    """Whether the positive role of an event (type, actor_roles) surely belongs to ``player``."""
    role = F.create_map(*[F.lit(v) for pair in POSITIVE_ROLES.items() for v in pair])
    actor = F.try_element_at(F.col("actor_roles"), F.try_element_at(role, F.col("type")))
    sure = (actor["player_id"] == player) & (actor["role_status"] == "confirmed") & (actor["identity_status"] == "confirmed")
    return F.coalesce(sure, F.lit(False))


def missing(required: DataFrame, included: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys that nothing includes."""
    return required.select(*keys).distinct().join(included.select(*keys).distinct(), list(keys), "left_anti")


def unequal(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the ``side`` that has them."""
    one, two = missing(left, right, keys), missing(right, left, keys)
    return one.withColumn("side", F.lit("left")).union(two.withColumn("side", F.lit("right")))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def broken_cuts(shots: DataFrame, clip: str = "clip", start: str = "start", end: str = "end") -> DataFrame:
    """Shots of a clip that do not begin where the shot before them ends."""
    w = Window.partitionBy(clip).orderBy(start, end)
    return shots.withColumn("last_end", F.lag(end).over(w)).where(F.col("last_end") != F.col(start))


def outside(clips: DataFrame, frames: str = "critical_frames") -> DataFrame:
    """Critical frames that lie outside their clip's [start, end)."""
    return clips.withColumn("frame", F.explode(frames)).where((F.col("frame") < F.col("start")) | (F.col("frame") >= F.col("end"))).drop(frames)


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose values differ between two tables of the same columns, or which one table lacks (cached calibrations)."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("left_"))
    b = right.select(*keys, F.struct(*values).alias("right_"))
    return a.join(b, list(keys), "full").where(~F.col("left_").eqNullSafe(F.col("right_"))).select(*keys)


def require_empty(broken: DataFrame, message: str, shown: int = 10) -> None:
    """Raise with the first few rows if a check found any; never more than ``shown`` rows reach the driver."""
    rows = broken.take(shown)
    if rows:
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in rows)}")
