"""Windows over an ordered axis: smoothing, trailing statistics, sampling, motion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import matching


def rows_around(keys: Sequence[str], order: str, before: int, after: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)


def median_smooth(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int = 13, least: int = 3) -> DataFrame:
    """Centred exact median of each component over ``width`` rows.

    A component keeps its value where fewer than ``least`` values are present, and a key with fewer than
    ``width`` rows is left as it is.
    """
    w = rows_around(keys, order, width // 2, width // 2)
    total = F.count("*").over(Window.partitionBy(*keys))
    new = {c: F.when((total >= width) & (F.count(c).over(w) >= least), F.percentile(c, 0.5).over(w)).otherwise(F.col(c)) for c in values}
    return rows.withColumns(new)


def moving_average(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int) -> DataFrame:
    """Centred mean over ``width // 2`` rows to either side, cut off at the edges; short keys stay."""
    w = rows_around(keys, order, width // 2, width // 2)
    total = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({c: F.when(total >= width, F.avg(c).over(w)).otherwise(F.col(c)) for c in values})


def gaussian_smooth(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], sigma: float) -> DataFrame:
    """Gaussian weights over int(3 sigma) rows to either side, scaled to the rows that are there."""
    w, radius = Window.partitionBy(*keys).orderBy(order), int(3 * sigma)
    weights = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)}

    def smooth(c: str) -> Column:
        terms = [(x, F.lag(c, -k).over(w)) for k, x in weights.items()]
        top = sum((F.coalesce(v * x, F.lit(0.0)) for x, v in terms), F.lit(0.0))
        return top / sum((F.when(v.isNotNull(), x).otherwise(0.0) for x, v in terms), F.lit(0.0))

    return rows.withColumns({c: smooth(c) for c in values})


def trailing(rows: DataFrame, keys: Sequence[str], order: str, value: str, span: int, how: str) -> Column:
    """Aggregate of ``value`` over the ``span`` units of ``order`` up to the row before it (range frame)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).cast("long")).rangeBetween(-span, -1)
    return {"max": F.max, "min": F.min, "avg": F.avg, "median": lambda c: F.percentile(c, 0.5), "count": F.count}[how](value).over(w)


def last_k(keys: Sequence[str], order: str, k: int) -> WindowSpec:
    """The row and the k - 1 before it."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - k, 0)


def speeds(rows: DataFrame, keys: Sequence[str], order: str, x: str, y: str, fps: float) -> DataFrame:
    """Speed from the row before, per second; null for the first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return rows.withColumn("speed", step / ((F.col(order) - F.lag(order).over(w)) / F.lit(float(fps))))


def turn_cosine(rows: DataFrame, keys: Sequence[str], order: str, x: str, y: str, reach: int) -> DataFrame:
    """Cosine between the movement into a row and out of it, over the rows at most ``reach`` frames away."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).cast("long"))
    before, after = w.rangeBetween(-reach, 0), w.rangeBetween(0, reach)
    ax, ay = F.col(x) - F.first(x).over(before), F.col(y) - F.first(y).over(before)
    bx, by = F.last(x).over(after) - F.col(x), F.last(y).over(after) - F.col(y)
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return rows.withColumn("turn_cosine", F.when(size > 0, (ax * bx + ay * by) / size))


def crossings(rows: DataFrame, keys: Sequence[str], order: str, at: str, value: str, level: float, longest: float) -> DataFrame:
    """Where ``value`` passes ``level`` from at or below to above between neighbours at most ``longest`` apart.

    Neighbours follow ``order``; ``at`` is their place in time, in which the crossing is interpolated.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    pair = rows.withColumns({"v0": F.lag(value).over(w), "t0": F.lag(at).over(w)})
    pair = pair.where((F.col("v0") <= level) & (F.col(value) > level) & (F.col(at) - F.col("t0") <= longest))
    share = (F.lit(level) - F.col("v0")) / (F.col(value) - F.col("v0"))
    return pair.withColumn("crossing", F.col("t0") + (F.col(at) - F.col("t0")) * share).drop("v0", "t0")


def sliding_windows(spans: DataFrame, length: int, stride: int) -> DataFrame:
    """Windows [start, end) of full ``length`` inside each span (start, end), every ``stride``; no partial tail."""
    fit = spans.where(F.col("end") - F.col("start") >= length)
    return fit.withColumn("window_start", F.explode(F.sequence("start", F.col("end") - length, F.lit(stride)))).withColumn("window_end", F.col("window_start") + length)


def uniform_sample(start: Column, end: Column, n: int) -> Column:
    """n frames spread evenly over [start, end], both ends included, cut to whole frames."""
    if n == 1:
        return F.array(F.floor(start).cast("long"))
    step = (end - start) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(start + i * step).cast("long"))


def around(centre: Column, half: int, stride: int, low: Column, high: Column) -> Column:
    """Frames every ``stride`` in [centre - half, centre + half), moved into [low, high]; the ends may repeat."""
    return F.transform(F.sequence(centre - half, centre + half - 1, F.lit(stride)), lambda i: F.greatest(low, F.least(high, i)))


def majority(rows: DataFrame, keys: Sequence[str], order: str, value: str, half: int, least: int) -> DataFrame:
    """Most frequent value among the rows around, where it has ``least`` votes; ties keep the row's own, then the least."""
    w = rows_around(keys, order, half, half)
    seen = rows.withColumn("all_", F.collect_list(value).over(w))
    votes = F.transform(F.array_distinct("all_"), lambda v: F.struct(F.size(F.filter("all_", lambda x: x == v)).alias("n"), (v == F.col(value)).cast("int").alias("own"), v.alias("v")))
    best = F.array_max(F.transform(votes, lambda s: F.struct(s["n"].alias("n"), s["own"].alias("own"))))
    pick = F.array_min(F.transform(F.filter(votes, lambda s: (s["n"] == best["n"]) & (s["own"] == best["own"])), lambda s: s["v"]))
    return seen.withColumn(value, F.when(best["n"] >= least, pick).otherwise(F.col(value))).drop("all_")


def trails(points: DataFrame, asked: DataFrame, keys: Sequence[str], length: int, gap: int) -> DataFrame:
    """Trail of each asked frame (keys, frame): the points (keys, at, x, y, z) of its last ``length`` frames in pieces.

    A hole of more than ``gap`` frames between two points begins a new piece. Points without finite place don't count.
    """
    finite = F.lit(True)
    for c in "xyz":
        finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    near = matching.within(asked.select(*keys, "frame").distinct(), points.where(finite).select(*keys, "at", "x", "y", "z"), keys, "frame", "at", 1 - max(1, length), 0)
    w = Window.partitionBy(*keys, "frame").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(w) <= gap + 1, 0).otherwise(1)
    pieces = near.where("at >= 0").withColumn("new_", new).withColumn("piece", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy(*keys, "frame", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y", "z"))).alias("points"))


def motion_visits(motion: DataFrame, keys: Sequence[str], fps: float, memory: int = 90, least: float = 0.025, ratio: float = 1.8) -> DataFrame:
    """Visits (keys, start, end, peak, relative) in which the motion (keys, frame, motion) stands out from what was usual.

    Usual is the median of the ``memory`` rows before, 0.01 without any and never under 0.006. Frames of ``least`` motion
    and ``ratio`` times the usual one belong to a visit; it ends when 0.2 seconds have passed without one, and counts if
    it spans two frames. The peak is its first frame of most relative motion.
    """
    before = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-memory, -1)
    usual = F.greatest(F.coalesce(F.percentile("motion", 0.5).over(before), F.lit(0.01)), F.lit(0.006))
    hits = motion.withColumn("relative", F.col("motion") / usual).where((F.col("motion") >= least) & (F.col("relative") >= ratio))
    w = Window.partitionBy(*keys).orderBy("frame")
    new = F.when(F.col("frame") - F.lag("frame").over(w) <= round(0.2 * fps) + 1, 0).otherwise(1)
    runs = hits.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "run_").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"), F.max_by("frame", F.struct("relative", -F.col("frame"))).alias("peak"), F.max("relative").alias("relative"))
    return spans.where(F.col("end") - F.col("start") >= 2).drop("run_")


def strided_sample(length: Column, n: int, rate: int, view: Column, views: int) -> Column:
    """n frames every ``rate`` of a video of ``length``, for one of ``views`` clips that spread evenly over it."""
    gap = F.greatest(length - ((n - 1) * rate + 1), F.lit(0)) / F.lit(float(max(1, views - 1)))
    start = F.bround(gap * view).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.greatest(F.least(start + i * rate, length - 1), F.lit(0)).cast("long"))
