"""Interval algebra on half-open spans of frames: islands, merges, run lengths, coverage, look-up.

Every function works per key, takes and returns DataFrames and needs one shuffle on the key; windows over the
same key and order share it. Spans are [start, end); an end of an inclusive span is turned over by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: Sequence[str], order: str, gap: float, name: str = "island", ties: Sequence[str] = ()) -> DataFrame:
    """Number the runs of rows whose neighbours in ``order`` are at most ``gap`` apart, from 1 in each key."""
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    new = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("new_", new).withColumn(name, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def island_spans(rows: DataFrame, keys: Sequence[str], order: str, gap: float, least: int = 1) -> DataFrame:
    """Start, inclusive end and number of rows of every island of at least ``least`` rows."""
    spans = islands(rows, keys, order, gap).groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    return spans.where(F.col("n") >= least)


def merge_spans(spans: DataFrame, keys: Sequence[str], tolerance: float = 0, collect: Sequence[str] = ()) -> DataFrame:
    """Union of spans that overlap, touch, or are at most ``tolerance`` apart.

    The break test compares with the greatest end so far, so a long span holds later short ones together.
    Columns in ``collect`` become sorted arrays of the merged rows' values.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= reach + tolerance, 0).otherwise(1)
    grouped = spans.withColumn("new_", new).withColumn("part_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.sort_array(F.collect_list(c)).alias(f"{c}s") for c in collect]
    return grouped.groupBy(*keys, "part_").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *sums).drop("part_")


def run_lengths(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], step: int | None = 1) -> DataFrame:
    """Maximal runs of equal ``values`` (null equals null) as [start, end); with ``step``, a gap in ``order`` ends a run."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in values:
        same &= F.col(c).eqNullSafe(F.lag(c).over(w))
    if step is not None:
        same &= F.col(order) - F.lag(order).over(w) == step
    new = F.when(F.lag(order).over(w).isNull() | ~same, 1).otherwise(0)
    parts = rows.withColumn("new_", new).withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "run", *values).agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.count("*").alias("n"))


def anchored_groups(rows: DataFrame, keys: Sequence[str], order: str, width: float) -> DataFrame:
    """Groups that end when a row is more than ``width`` after the group's first row.

    Unlike islands, the break depends on the first row, so it is folded over each key's sorted values. The
    array holds one key's rows, which a caller keeps to a segment.
    """
    sorted_ = F.sort_array(F.collect_list(order))
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.array().cast("array<struct<at:double,part:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["first"].isNull() | (x - s["first"] > width)
        n = F.when(fresh, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.when(fresh, x).otherwise(s["first"]).alias("first"), n.alias("n"), F.concat(s["out"], F.array(F.struct(x.alias("at"), n.alias("part")))).alias("out"))

    folded = rows.groupBy(*keys).agg(F.transform(sorted_, lambda x: x.cast("double")).alias("xs"))
    found = folded.select(*keys, F.inline(F.aggregate("xs", zero, step, lambda s: s["out"])))
    return found.groupBy(*keys, "part").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))


def point_in_span(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, bin_width: int) -> DataFrame:
    """Join points to the spans that hold them, as an equi-join on (keys, bin).

    Each span is listed under every bin it touches and each point under one, so a range condition never
    becomes a nested loop and a key with many rows is spread over its bins.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width)))
    listed = spans.where("start < end").withColumn("bin_", bins)
    placed = points.withColumn("bin_", F.floor(F.col(at) / bin_width))
    return placed.join(listed, [*keys, "bin_"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("bin_")


def expand(spans: DataFrame, inclusive: bool = False) -> DataFrame:
    """One row for every frame of a span."""
    last = F.col("end") if inclusive else F.col("end") - 1
    return spans.where(F.col("start") <= last).withColumn("frame", F.explode(F.sequence("start", last)))


def covered(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames covered by at least one span of each key, and the number of pieces."""
    return merge_spans(spans, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("pieces"))


def gaps(rows: DataFrame, keys: Sequence[str], order: str, longest: int) -> DataFrame:
    """Holes of more than one step between neighbouring rows, flagged where longer than ``longest``."""
    w = Window.partitionBy(*keys).orderBy(order)
    found = rows.select(*keys, (F.lag(order).over(w) + 1).alias("start"), F.col(order).alias("end")).where("start < end")
    return found.withColumn("length", F.col("end") - F.col("start")).withColumn("too_long", F.col("length") > longest)


def timeline(frames: DataFrame, layers: Sequence[tuple[str, Column]], otherwise: str = "unknown") -> DataFrame:
    """State of each frame by the first layer whose condition holds."""
    state = F.lit(otherwise)
    for name, holds in reversed(layers):
        state = F.when(holds, F.lit(name)).otherwise(state)
    return frames.withColumn("state", state)
