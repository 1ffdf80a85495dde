"""Admission of detections: thresholds, exclusion zones, court limits, human evidence, box clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking


def admit(boxes: DataFrame, least: Mapping[str, float], sizes: Mapping[str, tuple[float, float]], aspect: tuple[float, float] = (0.2, 5.0)) -> DataFrame:
    """Boxes (label, score, x1..y2) over their class's score, within its range of areas and with a sane shape."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ok = F.lit(False)
    for label, score in least.items():
        low, high = sizes.get(label, (0.0, float("inf")))
        ok |= (F.col("label") == label) & (F.col("score") >= score) & (w * h).between(low, high)
    return boxes.where(ok & (w > 0) & (h > 0) & (w / h).between(*aspect))


def route(first: DataFrame, second: DataFrame, own: Sequence[str]) -> DataFrame:
    """Classes ``own`` from the first detector, all others from the second."""
    return first.where(F.col("label").isin(*own)).unionByName(second.where(~F.col("label").isin(*own)))


def relabel(boxes: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Class numbers of a detector as names; unknown numbers go."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return boxes.withColumn("label", F.try_element_at(table, F.col("class_id"))).where("label is not null")


def outside_zones(balls: DataFrame, zones: DataFrame) -> DataFrame:
    """Balls (view, x, y) that lie in none of their view's circles (view, cx, cy, r)."""
    hit = balls.withColumn("row_", F.struct(*balls.columns)).join(zones, "view").where(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) <= F.pow("r", F.lit(2.0)))
    return balls.join(hit.select("row_").distinct(), F.struct(*[balls[c] for c in balls.columns]).eqNullSafe(F.col("row_")), "left_anti")


def top_in_court(players: DataFrame, keys: Sequence[str], most: int, court: tuple[float, float] = (15.0, 28.0), margin: float = 1.0) -> DataFrame:
    """Players whose place on the floor is inside the court, the ``most`` most confident of each picture."""
    inside = players.where(F.col("gx").between(-margin, court[0] + margin) & F.col("gy").between(-margin, court[1] + margin))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "det")
    return inside.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")


def is_human(points: Column, confidences: Column, x1: Column, y1: Column, x2: Column, y2: Column, least: int = 6, sure: float = 0.35, pad: float = 0.15) -> Column:
    """Whether enough sure joints lie in the padded box, with a shoulder and a hip, over half of its height."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    joined = F.zip_with(points, confidences, lambda p, c: F.struct(p[0].alias("x"), p[1].alias("y"), c.alias("c")))
    good = F.transform(joined, lambda j: F.when((j["c"] >= sure) & j["x"].between(x1 - px, x2 + px) & j["y"].between(y1 - py, y2 + py), j["y"]))
    seen = F.filter(good, lambda y: y.isNotNull())
    torso = (F.get(good, F.lit(5)).isNotNull() | F.get(good, F.lit(6)).isNotNull()) & (F.get(good, F.lit(11)).isNotNull() | F.get(good, F.lit(12)).isNotNull())
    return F.coalesce((F.size(seen) >= least) & torso & (F.array_max(seen) - F.array_min(seen) >= 0.5 * (y2 - y1)), F.lit(False))


def valid_ball(x: Column, y: Column, z: Column, court: tuple[float, float] = (15.0, 28.0), margin: float = 2.0, high: float = 8.0) -> Column:
    return F.coalesce(x.between(-margin, court[0] + margin) & y.between(-margin, court[1] + margin) & z.between(-0.75, high), F.lit(False))


def clip_to_window(boxes: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """Boxes (box) cut to the window; those without area left go."""
    cut = boxes.withColumn("box", ranking.clip_box(F.col("box"), *window))
    return cut.where(ranking.area(F.col("box")) > 0)


def drop_invalid(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1")))


def overlapping(boxes: DataFrame, other: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Boxes of which some other box covers at least the share ``least``: a semi join on overlap."""
    o = other.select(*keys, F.col("box").alias("o_box"))
    near = boxes.join(o, list(keys)).where(ranking.ioa(F.col("o_box"), F.col("box")) >= least).select(*keys, "det").distinct()
    return boxes.join(near, [*keys, "det"], "left_semi")


def scale_boxes(boxes: DataFrame, sx: float, sy: float) -> DataFrame:
    b = F.col("box")
    return boxes.withColumn("box", F.struct((b["x1"] * sx).alias("x1"), (b["y1"] * sy).alias("y1"), (b["x2"] * sx).alias("x2"), (b["y2"] * sy).alias("y2")))


def every_fourth_second(rows: DataFrame, second: str = "sec") -> DataFrame:
    """The subset that the quick evaluation uses."""
    return rows.where(F.col(second) % 4 == 0)


def wrong_predictions(rows: DataFrame, labels: Sequence[int] | None = None) -> DataFrame:
    """Rows (truth, predicted) that are wrong, within a set of labels where one is given."""
    wrong = rows.where("predicted <> truth")
    return wrong.where(F.col("truth").isin(*labels)) if labels else wrong


def confused_with(rows: DataFrame) -> DataFrame:
    """For each label the set of labels it was taken for."""
    return wrong_predictions(rows).groupBy("truth").agg(F.sort_array(F.collect_set("predicted")).alias("taken_for"))


def label_union(rows: DataFrame, video: str, labels: str) -> DataFrame:
    """Every row with the labels of its whole video."""
    every = rows.select(video, F.explode(labels).alias("l_")).groupBy(video).agg(F.sort_array(F.collect_set("l_")).alias("video_labels"))
    return rows.join(every, video, "left")


def merge_tagged(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted and true boxes in one table, each with its origin."""
    return predicted.withColumn("origin", F.lit("predicted")).unionByName(truth.withColumn("origin", F.lit("truth")), allowMissingColumns=True)


def balance(matrix: DataFrame, rounds: int = 3) -> DataFrame:
    """Alternate scaling of (row, col, value) so that columns and rows share their sums evenly."""
    out = matrix
    for _ in range(rounds):
        out = out.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("col")))
        out = out.withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("row")))
    return out


def average_parameters(checkpoints: DataFrame, low: int, high: int) -> DataFrame:
    """Mean of each parameter (name, i, value) over the checkpoints with ids in [low, high]."""
    return checkpoints.where(F.col("checkpoint").between(low, high)).groupBy("name", "i").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
