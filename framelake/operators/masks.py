"""Masks as runs of pixels: area, intersection and overlap of masks, and suppression by them.

A mask is a set of rows (keys, det, y, x0, x1): the pixels x0 to x1 - 1 of line y. Runs of a mask do not overlap. So a mask
costs as many rows as its outline is high, whatever its area. Masks may also come packed, one row each with an array of
these runs (keys, det, runs); others are packed first. Packed masks meet in a join on the keys, the picture, so rows that
are dealt by it already are not shuffled again, and lines never are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import _better, keep_greedily


def runs_of(masks: DataFrame, keys: Sequence[str], pixels: str, width: Column) -> DataFrame:
    """Runs of masks given as arrays of 0 and 1 by lines (row major, ``width`` pixels a line)."""
    at = masks.select(*keys, "det", width.alias("w_"), F.posexplode(pixels).alias("i_", "on_")).where("on_ <> 0")
    at = at.select(*keys, "det", F.floor(F.col("i_") / F.col("w_")).alias("y"), (F.col("i_") % F.col("w_")).cast("long").alias("x"))
    line = Window.partitionBy(*keys, "det", "y").orderBy("x")
    return at.withColumn("g_", F.col("x") - F.row_number().over(line)).groupBy(*keys, "det", "y", "g_").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("g_")


def areas(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys, "det").agg(F.sum(F.greatest(F.col("x1") - F.col("x0"), F.lit(0))).alias("area"))


def packed(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each mask that has a pixel: keys, det, further columns if packed already, runs, area and its box."""
    if "runs" not in runs.columns:
        runs = runs.groupBy(*keys, "det").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))
    solid = runs.withColumn("runs", F.filter("runs", lambda r: r["x0"] < r["x1"])).where(F.size("runs") > 0)
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["x1"] - r["x0"])
    ends = {"y0_": F.array_min("runs.y"), "y1_": F.array_max("runs.y"), "x0_": F.array_min("runs.x0"), "x1_": F.array_max("runs.x1")}
    return solid.withColumns({"area": size, **ends})


@F.arrow_udf(T.LongType())
def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Pixels that the runs of each pair of masks share."""
    def lines(runs: pa.Array) -> tuple[np.ndarray, ...]:
        flat = runs.flatten()
        pair = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        return pair, *(flat.field(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1"))

    (i, y, a0, a1), (j, v, b0, b1) = lines(left), lines(right)
    if not len(i) or not len(j):
        return pa.array(np.zeros(len(left), np.int64))
    low = min(y.min(), v.min())
    span = max(y.max(), v.max()) - low + 1
    mine, other = i * span + y - low, j * span + v - low
    order = np.argsort(other, kind="stable")
    other, b0, b1 = other[order], b0[order], b1[order]
    first = np.searchsorted(other, mine)
    count = np.searchsorted(other, mine, "right") - first
    a = np.repeat(np.arange(len(mine)), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    shared = np.maximum(np.minimum(a1[a], b1[b]) - np.maximum(a0[a], b0[b]), 0)
    return pa.array(np.bincount(i[a], shared, len(left)).astype(np.int64))


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], more: Sequence[str] = (), which: Column | None = None) -> DataFrame:
    """Pairs of packed masks with a common pixel, of those whose boxes meet; ``more`` are further columns of both, as o_ ones too."""
    mine = ["runs", "area", "y0_", "y1_", "x0_", "x1_", *more]
    other = right.select(*keys, F.col("det").alias("o_det"), *[F.col(c).alias(f"o_{c}") for c in mine])
    pairs = left.select(*keys, "det", *mine).join(other, list(keys))
    near = [(F.col(f"{c}0_") <= F.col(f"o_{c}1_")) & (F.col(f"o_{c}0_") <= F.col(f"{c}1_")) for c in "xy"]
    pairs = pairs.where(near[0] & near[1] if which is None else near[0] & near[1] & which)
    # Named as not deterministic, so that the filter on it does not work it out a second time.
    common = _common.asNondeterministic()(F.col("runs"), F.col("o_runs"))
    out = pairs.select(*keys, "det", "o_det", common.alias("common"), "area", "o_area", *more, *[f"o_{c}" for c in more]).where("common > 0")
    both = F.col("area") + F.col("o_area") - F.col("common")
    return out.withColumns({"iou": F.col("common") / both, "ioa": F.col("common") / F.col("o_area")})


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], which: Column | None = None) -> DataFrame:
    """keys, det, o_det, common (pixels), area, o_area, iou and ioa (share of the second mask) of masks that meet.

    ``which`` are the pairs (det, o_det) that are wanted, all if not given.
    """
    return _met(packed(left, keys), packed(right, keys), keys, which=which)


def suppress(runs: DataFrame, scores: DataFrame, keys: Sequence[str], overlap: float) -> DataFrame:
    """Greedy suppression of masks (keys, det, score): the ids that stay, those without a pixel among them."""
    met = overlaps(runs, runs, keys).where(F.col("iou") > overlap).select(*keys, "det", "o_det")
    rated = met.join(scores.select(*keys, "det", "score"), [*keys, "det"]).join(scores.select(*keys, F.col("det").alias("o_det"), F.col("score").alias("o_score")), [*keys, "o_det"])
    return keep_greedily(scores.select(*keys, "det", "score"), rated.where(_better()).select(*keys, "det", "o_det"), keys)


def suppress_classes(runs: DataFrame, scores: DataFrame | None, keys: Sequence[str], label: str, overlap: float, least: float) -> DataFrame:
    """Suppression within each class of masks that score over ``least``, ranked by falling score over all classes.

    Packed masks (one row each, those without a pixel too) may have the label and score themselves; then ``scores`` is None,
    the result has keys, label, det, score and rank, and every step keeps the rows dealt by ``keys``.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "det", label)
    if scores is not None:
        good = scores.where(F.col("score") > least)
        marked = runs.join(good.select(*keys, label, "det"), [*keys, "det"])
        kept = suppress(marked, good, [*keys, label], overlap)
        return good.join(kept, [*keys, label, "det"], "left_semi").withColumn("rank", F.row_number().over(w))
    good = runs.where(F.col("score") > least)
    solid = packed(good, keys).withColumnRenamed(label, "label_")
    edges = _met(solid, solid, keys, ["label_", "score"], (F.size(F.array_distinct(F.array("label_", "o_label_"))) == 1) & _better()).where(F.col("iou") > overlap)
    better = edges.groupBy(*keys, "det").agg(F.collect_set("o_det").alias("better"))
    one = F.struct((-F.col("score")).alias("s"), F.col("det").cast("bigint").alias("det"), F.col(label).alias("label"))
    listed = good.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    worse = better.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("det").cast("bigint").alias("det"), F.col("better").cast("array<bigint>").alias("better")))).alias("drop"))
    folded = listed.join(worse, list(keys), "left")
    none = F.array().cast("array<bigint>")
    over = lambda x: F.coalesce(F.try_element_at("drop", x["det"]), none)
    kept = F.aggregate("all", none, lambda s, x: F.when(F.arrays_overlap(s, over(x)), s).otherwise(F.concat(s, F.array(x["det"]))))
    found = folded.withColumn("kept", kept).select(*keys, F.explode(F.filter("all", lambda x: F.array_contains("kept", x["det"]))).alias("x"))
    found = found.select(*keys, F.col("x.label").alias(label), F.col("x.det").alias("det"), (-F.col("x.s")).alias("score"))
    return found.withColumn("rank", F.row_number().over(w))
