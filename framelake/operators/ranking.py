"""Quality of rankings and detections: curves, average precision, accuracy, confusion, votes, boxes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.sources.scratch import write_table


#: Rows of a bucket of the score and of a task, as long as there are at most so many buckets of a key.
BUCKET_ROWS, TASK_ROWS, MOST_BUCKETS = 50_000, 200_000, 1024


def _by_score(scored: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Adds ``bucket``: 0 holds the highest scores of a key; equal scores share a bucket of about equal size."""
    steps = F.percentile_approx("score", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000)
    edges = scored.groupBy(*keys).agg(F.array_distinct(steps).alias("edges_"))
    placed = scored.join(F.broadcast(edges), list(keys)).withColumn("below_", F.lit(0))
    # How many of the rising edges lie below the score, by halving: a column for each step, so that all of it is compiled.
    for step in (1 << i for i in reversed(range(buckets.bit_length()))):
        placed = placed.withColumn("below_", F.col("below_") + F.when(F.get("edges_", F.col("below_") + (step - 1)) < F.col("score"), step).otherwise(0))
    return placed.withColumn("bucket", F.coalesce(F.size("edges_"), F.lit(0)) - F.col("below_")).drop("edges_", "below_")


def precision_recall(scored: DataFrame, keys: Sequence[str], positives: DataFrame, tie: str, buckets: int | None = None) -> DataFrame:
    """Curve over rows (keys, score, hit 0/1) by falling score; ``positives`` has (keys, n_positive).

    Precision and recall after each row; recall is null where a key has no positive. Sums run within buckets
    of the score and start from the sums of the buckets before, so a class is not one task's work. Buckets and tasks
    grow in number with the rows, which are counted: ``scored`` should be as cheap to read as a table. Keys are classes,
    so few that a row for each of their buckets can be broadcast.
    """
    rows = scored.count()
    placed = _by_score(scored, keys, min(MOST_BUCKETS, buckets or max(64, rows // BUCKET_ROWS)))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "bucket").agg(F.sum("hit").alias("h_"), F.count("*").alias("c_"))
    starts = sums.select(*keys, "bucket", F.coalesce(F.sum("h_").over(before), F.lit(0)).alias("h_"), F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("c_"))
    tasks = max(scored.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    w = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score"), tie).rowsBetween(Window.unboundedPreceding, 0)
    curve = placed.repartition(tasks, *keys, "bucket").withColumns({"tp": F.sum("hit").over(w), "n": F.count("*").over(w)})
    curve = curve.join(F.broadcast(starts), [*keys, "bucket"]).withColumns({"tp": F.col("h_") + F.col("tp"), "n": F.col("c_") + F.col("n")}).drop("h_", "c_")
    curve = curve.join(F.broadcast(positives), list(keys), "left")
    return curve.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.when(F.col("n_positive") > 0, F.col("tp") / F.col("n_positive"))})


def average_precision(curve: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Area under the precision envelope where recall rises; the envelope is the best precision from a row on.

    The envelope is a running maximum from the lowest score up, again within buckets and then across them.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    best = curve.groupBy(*keys, "bucket").agg(F.max("precision").alias("b_")).select(*keys, "bucket", F.max("b_").over(later).alias("later_"))
    up = Window.partitionBy(*keys, "bucket").orderBy("score", F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    joined = curve.withColumn("best_", F.max("precision").over(up)).join(F.broadcast(best), [*keys, "bucket"])
    envelope = F.greatest("best_", "later_")
    area = joined.withColumn("area", envelope * F.col("hit") / F.when(F.col("n_positive") > 0, F.col("n_positive")))
    return area.groupBy(*keys).agg(F.sum("area").alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """Mean over the classes that have positives."""
    return ap.agg(F.avg("ap").alias("map"), F.count("ap").alias("classes"))


def rank_of_truth(scores: DataFrame, sample: str, label: str, truth: str) -> DataFrame:
    """Position of the true label of each sample by falling score, ties by label."""
    w = Window.partitionBy(sample).orderBy(F.desc("score"), label)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col(label) == F.col(truth)).select(sample, "rank")


def topk(ranks: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Correct samples, accuracy and error in percent for each k."""
    out = []
    for k in ks:
        out += [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"top{k}_correct"), (100 * F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"top{k}_accuracy"), (100 - 100 * F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))).alias(f"top{k}_error")]
    return ranks.agg(*out)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of (truth, predicted) with the share of the truth's rows, in long form; pivot it to a matrix."""
    counts = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def confusion_matrix(rows: DataFrame, truth: str, predicted: str, labels: Sequence[object]) -> DataFrame:
    """Confusion as a matrix with one column for each given label."""
    return rows.groupBy(truth).pivot(predicted, list(labels)).count().na.fill(0)


def class_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0)
    return rows.groupBy(truth).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """sqrt(total / (classes * count)) of each class."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sqrt(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))))


def distribution(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def ensemble(clips: DataFrame, clip: str, label: str, n_clips: int, how: str = "sum") -> DataFrame:
    """Scores of a video from those of its clips: video = clip div n_clips, sum or max for each label."""
    f = {"sum": F.sum, "max": F.max}[how]
    return clips.groupBy(F.floor(F.col(clip) / n_clips).alias("video"), label).agg(f("score").alias("score"), F.count("*").alias("clips"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


#: Queries and rows of memory that are compared at once.
QUERY_TILE, MEMORY_TILE = 1024, 8192


def _unit(vector: Column) -> Column:
    """``vector`` scaled to length 1; null without a direction."""
    scaled = F.transform(F.array(norm(vector)), lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)))
    return F.get(scaled, 0)


def _nearest(k: int, columns: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=columns)
        q, m = np.stack(asked["q_unit"]), np.stack(held["unit"])
        rough = q @ m.T
        # The product's last digits depend on the place in the tile, so rows about as near as the k-th are computed again.
        least = np.partition(rough, len(m) - k, axis=1)[:, [len(m) - k]] - 1e-9 if len(m) > k else np.full((len(q), 1), -np.inf)
        i, j = np.nonzero(rough >= least)
        out = held.drop(columns="unit").iloc[j].reset_index(drop=True)
        out["query"], out["similarity"] = asked["query"].to_numpy()[i], (q[i] * m[j]).sum(axis=1)
        return out.sort_values(["query", "similarity", "id"], ascending=[True, False, True]).groupby("query").head(k)[columns]

    return run


def retrieve(queries: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """The k rows of ``memory`` (id, vector, ...) with the largest cosine to each query (query, q_vector).

    The query set is stated and compared with all rows: both sides are dealt into tiles of bounded size by their ids,
    each pair of tiles is one matrix product of unit vectors, and keeps its own k best of every query before the tiles
    meet. Ties go to the smaller id. Vectors without a direction, and those of other lengths, are not near.
    """
    tiles, parts = -(-queries.count() // QUERY_TILE) or 1, -(-memory.count() // MEMORY_TILE) or 1

    def dealt(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = queries.select("query", _unit(F.col("q_vector")).alias("q_unit")).where("q_unit is not null")
    asked = asked.select("*", F.size("q_unit").alias("size_"), dealt("query", tiles).alias("tile_"), every(parts).alias("part_"))
    held = memory.withColumn("unit", _unit(F.col("vector"))).drop("vector").where("unit is not null")
    held = held.select("*", F.size("unit").alias("size_"), dealt("id", parts).alias("part_"), every(tiles).alias("tile_"))
    keys = ["size_", "tile_", "part_"]
    kept = [f for f in memory.schema if f.name != "vector"]
    schema = T.StructType([queries.schema["query"], *kept, T.StructField("similarity", T.DoubleType())])
    run = _nearest(k, schema.names)
    left, right = asked.groupBy(*keys), held.groupBy(*keys)
    short = left.cogroup(right).applyInPandas(lambda key, a, b: run(a.drop(columns=keys), b.drop(columns=keys)), schema)
    final = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return short.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def weighted_vote(neighbours: DataFrame, label: str, temperature: float) -> DataFrame:
    """Sum of exp(similarity / temperature) of the neighbours, by query and label."""
    return neighbours.groupBy("query", label).agg(F.sum(F.exp(F.col("similarity") / temperature)).alias("vote"))


def blend(a: Column, b: Column, ratio: float) -> Column:
    return ratio * a + (1 - ratio) * b


#: Boxes are structs or columns x1, y1, x2, y2.
def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def ioa(a: Column, b: Column) -> Column:
    """Share of b that a covers."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(0.0)


def match_boxes(found: DataFrame, truth: DataFrame, keys: Sequence[str], least: float, more: Sequence[str] = ()) -> DataFrame:
    """Detections (keys, det, box, score, place) tested against truth (keys, gt, gt_box); ``more`` columns of truth come along.

    A detection goes to the truth box it overlaps most; of the detections of a truth box with enough overlap
    the first in ``place`` is the hit, the others are false.
    """
    pairs = found.join(truth, list(keys), "left").withColumn("overlap", F.coalesce(iou(F.col("box"), F.col("gt_box")), F.lit(0.0)))
    best = pairs.groupBy(*keys, "det", "score", "place").agg(F.max_by(F.struct("gt", "overlap", *more), F.struct("overlap", -F.col("gt"))).alias("m"))
    enough = F.col("m.gt").isNotNull() & (F.col("m.overlap") >= least)
    w = Window.partitionBy(*keys, F.when(enough, F.col("m.gt"))).orderBy("place")
    return best.withColumn("hit", F.when(enough & (F.row_number().over(w) == 1), 1).otherwise(0)).select(*keys, "det", "score", "place", F.col("m.gt").alias("gt"), F.col("m.overlap").alias("overlap"), "hit", *[f"m.{c}" for c in more])


def clip_box(b: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    def bound(v: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(low), F.least(F.lit(high), v))

    return F.struct(bound(b["x1"], x1, x2).alias("x1"), bound(b["y1"], y1, y2).alias("y1"), bound(b["x2"], x1, x2).alias("x2"), bound(b["y2"], y1, y2).alias("y2"))


def near_boxes(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Pairs of boxes (box, o_box) of one key that overlap, joined by the cells of a grid that both touch.

    A pair that shares several cells is taken from the one with the corner of its intersection.
    """
    def cells(b: Column, c: str) -> Column:
        return F.explode(F.sequence(F.floor(b[f"{c}1"] / cell), F.floor(b[f"{c}2"] / cell)))

    def listed(rows: DataFrame, box: str) -> DataFrame:
        b = F.col(box)
        solid = rows.where((b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"]))
        return solid.withColumn("cx_", cells(b, "x")).withColumn("cy_", cells(b, "y"))

    a, b = F.col("box"), F.col("o_box")
    pairs = listed(left, "box").join(listed(right, "o_box"), [*keys, "cx_", "cy_"])
    corner = [F.floor(F.greatest(a[f"{c}1"], b[f"{c}1"]) / cell) for c in "xy"]
    return pairs.where((F.col("cx_") == corner[0]) & (F.col("cy_") == corner[1]) & (intersection(a, b) > 0)).drop("cx_", "cy_")


def _better() -> Column:
    return (F.col("o_score") > F.col("score")) | ((F.col("o_score") == F.col("score")) & (F.col("o_det") < F.col("det")))


def keep_greedily(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids (keys, det) that stay of ``rows`` (keys, det, score) when the best goes first and drops its neighbours.

    ``edges`` has (keys, det, o_det) for every pair too near to another, o_det the better one. The rows of one key, an
    image, are folded in order of their score.
    """
    neighbours = edges.groupBy(*keys, "det").agg(F.collect_set("o_det").alias("better"))
    listed = rows.join(neighbours, [*keys, "det"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "det", F.coalesce("better", F.array().cast("array<bigint>")).alias("better")))).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<bigint>"), lambda s, x: F.when(F.arrays_overlap(s, x["better"]), s).otherwise(F.concat(s, F.array(x["det"].cast("bigint")))))
    return listed.select(*keys, F.explode(kept).alias("det"))


def suppress(boxes: DataFrame, keys: Sequence[str], overlap: float, cell: float = 64.0) -> DataFrame:
    """Greedy non-maximum suppression of (keys, det, score, box): the ids that stay.

    Pairs are found in cells of the plane of the given size, which should be about that of a usual box.
    """
    mine = boxes.select(*keys, "det", "score", "box")
    other = boxes.select(*keys, F.col("det").alias("o_det"), F.col("score").alias("o_score"), F.col("box").alias("o_box"))
    edges = near_boxes(mine, other, keys, cell).where(_better() & (iou(F.col("box"), F.col("o_box")) > overlap)).select(*keys, "det", "o_det")
    return keep_greedily(mine, edges, keys)


def suppress_classes(boxes: DataFrame, keys: Sequence[str], label: str, overlap: float, least: float, cell: float = 64.0) -> DataFrame:
    """Suppression within each class of boxes that score over ``least``, ranked by falling score over all classes."""
    good = boxes.where(F.col("score") > least)
    kept = suppress(good, [*keys, label], overlap, cell)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "det", label)
    return good.join(kept, [*keys, label, "det"], "left_semi").withColumn("rank", F.row_number().over(w))


def evaluate_detections(found: DataFrame, truth: DataFrame, keys: Sequence[str], label: str, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Average precision by class and one row of means, from detections and truth boxes.

    ``found`` has keys, label, det, score, box; ``truth`` keys, label, gt, gt_box, difficult. Within a key and class a
    detection goes to the truth box it overlaps most; the best scored of a truth box's detections is the hit. Those of a
    difficult box count neither way, and difficult boxes are no positives. Boxes without an area are left out.

    The first table has label, n_positive, ap (null without positives); the second map, the mean over classes with
    positives, and pooled: the average precision of one curve over the detections of all these classes, in which every
    class weighs as much as it has positives.
    """
    whole = found.where((F.col("box.x1") < F.col("box.x2")) & (F.col("box.y1") < F.col("box.y2")))
    order = Window.partitionBy(*keys, label).orderBy(F.desc("score"), "det")
    placed = whole.withColumn("place", F.row_number().over(order))
    same = F.max("difficult").over(Window.partitionBy(*keys, label, "gt"))
    held = truth.select(*keys, label, "gt", "gt_box", F.coalesce(same, F.lit(False)).alias("hard_"))
    met = match_boxes(placed.select(*keys, label, "det", "score", "place", "box"), held, [*keys, label], least, ["hard_"])
    judged = met.where(F.col("gt").isNull() | ~F.col("hard_") | (F.col("overlap") < least))
    # One row for each class.
    positives = write_table(truth.groupBy(label).agg(F.count_if(~F.col("difficult")).alias("n_positive")), "positives")
    scored = judged.join(F.broadcast(positives.where("n_positive > 0")), label, "left_semi").withColumn("tie_", F.xxhash64(*keys, label, "det"))
    # Boxes are matched once; both curves read what is left of them several times.
    scored = write_table(scored.select(label, "score", "hit", "tie_", F.lit(1.0).alias("all_")), "judged")
    by_class = average_precision(precision_recall(scored, [label], positives, "tie_"), [label], "tie_")
    # A class with positives and no detections has an empty curve.
    classes = positives.join(by_class, label, "left").withColumn("ap", F.when(F.col("n_positive") > 0, F.coalesce("ap", F.lit(0.0))))
    # One key for all rows.
    total = positives.agg(F.sum("n_positive").alias("n_positive")).select(F.signum(F.col("n_positive") + 1.0).alias("all_"), "n_positive")
    curve = precision_recall(scored, ["all_"], total, "tie_")
    pooled = average_precision(curve, ["all_"], "tie_").select(F.lit(None).cast("double").alias("map"), F.col("ap").alias("pooled"))
    means = classes.agg(F.avg("ap").alias("map")).withColumn("pooled", F.lit(None).cast("double")).union(pooled)
    return classes, means.agg(F.max("map").alias("map"), F.max("pooled").alias("pooled"))
