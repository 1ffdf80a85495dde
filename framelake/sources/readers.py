"""Readers: bundles of nested JSON, sidecar lines, track lines, label lists and box tables as long DataFrames.

Nested maps keyed by frame, track and view become long tables with a row for each leaf. Frame keys are strings
that may read as decimals; NaN becomes null here, once, so that comparisons need no guards later.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the version that bundles name.
VERSION = "2.0-rfdetr-rtmpose"
_POINT = "array<double>"
_POSE = "struct<bbox:array<double>,keypoints_xy:array<array<double>>,keypoints_conf:array<double>,mask_foot_xy:array<double>,ground_position:array<double>,detection_confidence:double>"
_BALL = "struct<center_xy:array<double>,bbox:array<double>,confidence:double>"
_QUALITY = "struct<views:array<string>,predicted_3d:boolean,predicted_track:boolean,mean_reprojection_error_px:double>"
BUNDLE = f"""schema_version string,
 video_info map<string,struct<path:string,width:int,height:int,fps:double,total_frames:int,frame_offset:int>>,
 poses_3d map<string,map<string,array<array<double>>>>,
 poses_2d map<string,map<string,map<string,{_POSE}>>>,
 ground_positions_3d map<string,map<string,{_POINT}>>,
 balls_2d map<string,map<string,{_BALL}>>,
 balls_3d map<string,{_POINT}>,
 balls_3d_predicted map<string,boolean>,
 ball_measurements map<string,struct<position:array<double>,views:int>>,
 quality map<string,map<string,{_QUALITY}>>"""


def frame_number(key: Column) -> Column:
    """Frame of a map key; ``"12.0"`` is frame 12, anything else that is no number is null."""
    return key.try_cast("double").cast("int")


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(point: Column) -> Column:
    """Whether an array of three numbers is present in full."""
    return F.coalesce((F.size(point) >= 3) & F.forall(point, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _guard(df: DataFrame, ok: Column, message: str) -> DataFrame:
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_bundle(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """Bundles as they stand, one row a file with ``segment`` from the file name.

    The query fails on another version, on views of different rates, and on a bundle without any frame.
    """
    raw = spark.read.schema(BUNDLE).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    raw = raw.withColumn("segment", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    rates = F.array_distinct(F.transform(F.map_values("video_info"), lambda v: v["fps"]))
    checked = _guard(raw, F.col("schema_version") == version, "unknown bundle version")
    checked = _guard(checked, (F.size(rates) == 1) & (rates[0] > 0), "views need one positive frame rate")
    return _guard(checked, F.size("poses_2d") > 0, "bundle without frames")


def segments(bundle: DataFrame) -> DataFrame:
    """segment, fps, start, end: frames [least, greatest + 1) with an observation."""
    keys = F.transform(F.map_keys("poses_2d"), lambda k: k.try_cast("double").cast("int"))
    return bundle.select("segment", F.map_values("video_info")[0]["fps"].alias("fps"), F.array_min(keys).alias("start"), (F.array_max(keys) + 1).alias("end"))


def views(bundle: DataFrame) -> DataFrame:
    """segment, view and its video; ``frame_zero`` is minus the offset."""
    v = bundle.select("segment", F.explode("video_info").alias("view", "v")).select("segment", "view", "v.*")
    return v.withColumn("frame_zero", -F.coalesce("frame_offset", F.lit(0)))


def poses(bundle: DataFrame) -> DataFrame:
    """segment, frame, track, view and the observation's columns."""
    a = bundle.select("segment", F.explode("poses_2d").alias("f", "tracks")).select("segment", frame_number(F.col("f")).alias("frame"), F.explode("tracks").alias("track", "by_view"))
    return a.select("segment", "frame", "track", F.explode("by_view").alias("view", "o")).select("segment", "frame", "track", "view", "o.*")


def hands(pose: DataFrame) -> DataFrame:
    """Wrists of every observation, for the contact operators."""
    wrist = F.transform(F.array(F.lit(9), F.lit(10)), lambda i: F.struct(no_nan(F.get("keypoints_xy", i)[0]).alias("x"), no_nan(F.get("keypoints_xy", i)[1]).alias("y"), F.get("keypoints_conf", i).alias("confidence")))
    return pose.select("segment", "frame", "view", "track", (F.get("bbox", F.lit(3)) - F.get("bbox", F.lit(1))).alias("height"), F.filter(wrist, lambda w: w["x"].isNotNull() & w["y"].isNotNull()).alias("wrists"))


def balls(bundle: DataFrame) -> DataFrame:
    """segment, frame, view, x, y, radius (a quarter of width plus height), confidence."""
    a = bundle.select("segment", F.explode("balls_2d").alias("f", "by_view")).select("segment", frame_number(F.col("f")).alias("frame"), F.explode("by_view").alias("view", "b"))
    box = F.col("b.bbox")
    return a.select("segment", "frame", "view", no_nan(F.col("b.center_xy")[0]).alias("x"), no_nan(F.col("b.center_xy")[1]).alias("y"), ((box[2] - box[0] + box[3] - box[1]) / 4).alias("radius"), F.col("b.confidence").alias("confidence"))


def ground(bundle: DataFrame) -> DataFrame:
    a = bundle.select("segment", F.explode("ground_positions_3d").alias("f", "tracks")).select("segment", frame_number(F.col("f")).alias("frame"), F.explode("tracks").alias("track", "p"))
    return a.where(finite(F.col("p"))).select("segment", "frame", "track", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))


def ball_positions(bundle: DataFrame) -> DataFrame:
    """Measured balls in space: ``ball_measurements`` where a segment has them, else ``balls_3d`` not marked as predicted."""
    own = bundle.select("segment", F.explode("ball_measurements").alias("f", "m")).select("segment", frame_number(F.col("f")).alias("frame"), F.col("m.position").alias("p"), F.col("m.views").alias("views"))
    seen = bundle.where(F.coalesce(F.size("ball_measurements"), F.lit(0)) == 0).select("segment", "balls_3d_predicted", "balls_2d", F.explode("balls_3d").alias("f", "p"))
    predicted = F.coalesce(F.try_element_at("balls_3d_predicted", F.col("f")), F.lit(False))
    count = F.greatest(F.coalesce(F.size(F.try_element_at("balls_2d", F.col("f"))), F.lit(0)), F.lit(2))
    other = seen.where(~predicted).select("segment", frame_number(F.col("f")).alias("frame"), "p", count.alias("views"))
    both = own.unionByName(other).where(finite(F.col("p")))
    return both.select("segment", "frame", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"), "views")


def read_evidence(spark: SparkSession, path: str, frames: DataFrame | None = None) -> DataFrame:
    """Sidecar lines: the last line of a frame counts; with ``frames`` (start, end) a frame outside is an error."""
    schema = f"schema_version string, frame int, candidates map<string,array<{_BALL}>>, selected_observed_2d map<string,{_BALL}>, measured_3d array<double>, filtered_3d_predicted boolean, selection_note string"
    lines = spark.read.schema(schema).json(path).withColumns({"file_": F.input_file_name(), "line_": F.monotonically_increasing_id()})
    last = lines.withColumn("n_", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("line_")))).where("n_ = 1").drop("n_", "line_", "file_")
    if frames is None:
        return last
    start, end = frames.agg(F.min("start"), F.max("end")).first()
    return _guard(last, (F.col("frame") >= start) & (F.col("frame") < end), "evidence frame outside the segment")


def hoop_centre(candidates: list[tuple[str, DataFrame]], default: tuple[float, float, float]) -> DataFrame:
    """The first source, in the order given, that has a finite centre (segment, p); else the default, with its name."""
    rows = [df.select("segment", F.lit(i).alias("rank"), F.lit(name).alias("source"), F.when(finite(F.col("p")), F.col("p")).alias("p")) for i, (name, df) in enumerate(candidates)]
    every = reduce(DataFrame.unionByName, rows)
    best = every.groupBy("segment").agg(F.min(F.when(F.col("p").isNotNull(), F.struct("rank", "source", "p"))).alias("b"))
    return best.select("segment", F.coalesce("b.source", F.lit("default")).alias("source"), F.coalesce("b.p", F.array(*map(F.lit, default))).alias("p"))


def read_labelled_paths(spark: SparkSession, path: str, separator: str = " ", clips: int = 1) -> DataFrame:
    """Lines of a path, an optional frame count and a label (0 where absent), repeated for each clip."""
    part = F.split(F.trim("value"), f"[{separator}]")
    n = F.size(part)
    rows = spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("path"), F.when(n >= 3, F.get(part, F.lit(1)).try_cast("int")).alias("frames"), F.when(n >= 2, F.get(part, n - 1).try_cast("int")).otherwise(0).alias("label"))
    return rows.withColumn("clip", F.explode(F.sequence(F.lit(0), F.lit(clips - 1))))


def read_chunk(rows: DataFrame, order: str, skip: int, size: int) -> DataFrame:
    """Rows [skip, skip + size) in order; past the end it starts again at the beginning."""
    total = rows.count()
    start = skip if skip < total else 0
    return rows.orderBy(order).offset(start).limit(size)


def read_frame_lists(spark: SparkSession, path: str) -> DataFrame:
    """Paths of each video in frame order, from a table with a header and five columns."""
    raw = spark.read.option("header", True).option("sep", " ").schema("original_vido_id string, video_id int, frame_id int, path string, labels string").csv(path)
    listed = raw.groupBy(F.col("original_vido_id").alias("video")).agg(F.sort_array(F.collect_list(F.struct("frame_id", "path", "labels"))).alias("all"))
    return listed.select("video", F.col("all.path").alias("paths"), F.col("all.labels").alias("labels"))


_BOXES = "video string, sec int, x1 double, y1 double, x2 double, y2 double, label int, score double"


def read_boxes(spark: SparkSession, path: str, least_score: float | None = None, every: int = 1) -> DataFrame:
    """Boxes of a table without header: one row a box with its labels; scores below the threshold and seconds off the step go."""
    rows = spark.read.schema(_BOXES).csv(path).where(F.col("sec") % every == 0)
    if least_score is not None:
        rows = rows.where(F.col("score") >= least_score)
    return rows.groupBy("video", "sec", "x1", "y1", "x2", "y2").agg(F.sort_array(F.collect_set(F.when(F.col("label") > 0, F.col("label")))).alias("labels"), F.max("score").alias("score"))


def drop_excluded(boxes: DataFrame, excluded: DataFrame) -> DataFrame:
    return boxes.join(excluded.select("video", "sec").distinct(), ["video", "sec"], "left_anti")


def keep_classes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    return boxes.join(classes.select("label").distinct(), "label", "left_semi")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """label, name of a text label map with one ``name`` and one ``id`` line in each item."""
    text = spark.read.text(path, wholetext=True)
    items = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(\{[^}]*\})"), F.lit(1)))
    item = text.select(items.alias("item"))
    return item.select(F.regexp_extract("item", r"id:\s*(\d+)", 1).cast("int").alias("label"), F.regexp_extract("item", r'name:\s*"([^"]*)"', 1).alias("name")).where("label is not null")


def join_labels(videos: DataFrame, labels: DataFrame) -> DataFrame:
    """Videos with a label, by id; brackets in templates are taken off first."""
    clean = labels.withColumn("template", F.regexp_replace("template", r"[\[\]]", ""))
    return videos.join(clean, "id")


def rewrite_paths(splits: DataFrame, root: str) -> DataFrame:
    """One row for each source path (of the first split that names it), moved under ``root`` by its last two parts."""
    first = splits.groupBy("path").agg(F.min_by("split", "order").alias("split"), F.min("order").alias("order"))
    part = F.split("path", "/")
    return first.withColumn("moved", F.concat_ws("/", F.lit(root), F.slice(part, F.greatest(F.size(part) - 1, F.lit(1)), 2)))


def number_samples(batches: DataFrame, values: str) -> DataFrame:
    """Rows of ragged samples, each with the number of its sample in front."""
    return batches.select("batch", "sample", F.posexplode(values).alias("i", "value"))
