"""Queries of the admission operators over the boxes of the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import scalar as X
from framelake.operators import admission as A

from .registry import query
from .views import DETECTIONS, OBSERVATIONS, PREDICTIONS, detections, observations, predictions, table

_SIDES = ("x1", "y1", "x2", "y2")


def _flat(boxes: DataFrame) -> DataFrame:
    return boxes.select(*[c for c in boxes.columns if c != "box"], *[F.col(f"box.{c}").alias(c) for c in _SIDES])


@query(f"""with {DETECTIONS} select image, det, label, score from det where (x2 - x1) / (y2 - y1) between 0.5 and 1.5 and x2 > x1 and y2 > y1
and (label = 'A' and score >= 20000 and (x2 - x1) * (y2 - y1) between 60 and 180 or label = 'N' and score >= 35000 and (x2 - x1) * (y2 - y1) between 0 and 150 or label = 'R' and score >= 10000)""")
def admitted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(detections(spark, sf_dir))
    return A.admit(flat, {"A": 20000, "N": 35000, "R": 10000}, {"A": (60, 180), "N": (0, 150)}, (0.5, 1.5)).select("image", "det", "label", "score")


@query(f"with {DETECTIONS} select image, det, label, score, 'first' as origin from det where det % 2 = 0 and label in ('A', 'R') union all select image, det, label, score, 'second' from det where det % 3 = 0 and label not in ('A', 'R')")
def routed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir).select("image", "det", "label", "score")
    first, second = (boxes.where(F.col("det") % k == 0).withColumn("origin", F.lit(name)) for k, name in ((2, "first"), (3, "second")))
    return A.route(first, second, ["A", "R"])


@query(f"with {DETECTIONS} select image, det, det % 5 as class_id, case det % 5 when 0 then 'ball' when 2 then 'player' when 3 then 'hoop' end as label from det where det % 5 in (0, 2, 3)")
def relabelled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir).select("image", "det", (F.col("det") % 5).alias("class_id"))
    return A.relabel(boxes, {0: "ball", 2: "player", 3: "hoop"})


_ZONES = [("A", 2.0, 3.0, 2.5), ("A", 8.0, 8.0, 1.0), ("N", 5.0, 5.0, 4.0)]


@query(f"""with {DETECTIONS}, z(view, cx, cy, r) as (values {", ".join(f"('{v}', {x}::double, {y}::double, {r}::double)" for v, x, y, r in _ZONES)})
select image, det, label as view, x1 as x, y1 as y from det where not exists (select 1 from z where z.view = label and (x1 - cx) ** 2 + (y1 - cy) ** 2 <= r ** 2)""")
def balls_outside_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = detections(spark, sf_dir).select("image", "det", F.col("label").alias("view"), F.col("box.x1").alias("x"), F.col("box.y1").alias("y"))
    return A.outside_zones(balls, F.broadcast(spark.createDataFrame(_ZONES, "view string, cx double, cy double, r double")))


@query(f"with {DETECTIONS}, c as (select image, det, score, x1 * 2 as gx, y1 * 4 as gy from det) select * exclude (n) from (select *, row_number() over (partition by image order by score desc, det) as n from c where gx between -1 and 16 and gy between -1 and 29) where n <= 2")
def players_in_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = detections(spark, sf_dir).select("image", "det", "score", (F.col("box.x1") * 2).alias("gx"), (F.col("box.y1") * 4).alias("gy"))
    return A.top_in_court(players, ["image"], 2)


@query(f"""with {DETECTIONS}, c as (select image, det, least(greatest(x1, 4), 11) as x1, least(greatest(y1, 3), 12) as y1, least(greatest(x2, 4), 11) as x2, least(greatest(y2, 3), 12) as y2 from det)
select image, det, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2 from c where x2 > x1 and y2 > y1""")
def boxes_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(A.clip_to_window(detections(spark, sf_dir).select("image", "det", "box"), (4.0, 3.0, 11.0, 12.0)))


@query(f"with {DETECTIONS} select image, det, x1, y1, x2 - 8 as x2, y2 - 10 as y2 from det where x2 - 8 > x1 and y2 - 10 > y1")
def valid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("box")
    moved = F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), (b["x2"] - 8).alias("x2"), (b["y2"] - 10).alias("y2"))
    return _flat(A.drop_invalid(detections(spark, sf_dir).select("image", "det", moved.alias("box"))))


@query(f"with {DETECTIONS} select image, det, x1 * 0.5::double as x1, y1 * 0.25::double as y1, x2 * 0.5::double as x2, y2 * 0.25::double as y2 from det")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(A.scale_boxes(detections(spark, sf_dir).select("image", "det", "box"), 0.5, 0.25))


@query(f"with {DETECTIONS} select image, det, label, score, 'predicted' as origin, null as note from det where score >= 30000 union all select image, det, label, null, 'truth', 'line ' || det from det where det <= 2")
def tagged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir).select("image", "det", "label", "score")
    return A.merge_tagged(boxes.where("score >= 30000"), boxes.where("det <= 2").drop("score").withColumn("note", F.concat(F.lit("line "), F.col("det").cast("string"))))


@query(f"with {OBSERVATIONS} select event_id, frame from obs where frame % 4 = 0")
def quick_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.every_fourth_second(observations(spark, sf_dir).select("event_id", "frame"), "frame")


_GUESS = "g as (select p_partkey as sample, p_size % 5 as truth, (p_partkey * 7 + p_size) % 5 as predicted from part)"


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("sample"), (s % 5).alias("truth"), ((k * 7 + s) % 5).alias("predicted"))


@query(f"with {_GUESS} select sample, truth, predicted from g where truth <> predicted and truth in (1, 3)")
def wrong_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.wrong_predictions(_guesses(spark, sf_dir), [1, 3])


@query(f"with {_GUESS} select truth, string_agg(cast(predicted as varchar), ',' order by predicted) as taken_for from (select distinct truth, predicted from g where truth <> predicted) group by truth")
def taken_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confused_with(_guesses(spark, sf_dir)).select("truth", F.array_join(F.col("taken_for").cast("array<string>"), ",").alias("taken_for"))


@query(f"""with {OBSERVATIONS}, v as (select track, string_agg(kind, ',' order by kind) as video_labels from (select distinct track, kind from obs) group by track)
select event_id, track, video_labels from obs join v using (track)""")
def labels_of_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("event_id", "track", F.array("kind").alias("labels"))
    return A.label_union(rows, "track", "labels").select("event_id", "track", F.array_join("video_labels", ",").alias("video_labels"))


def _turn(name: str, before: str) -> str:
    half = f'{name}c as (select "row", col, value / sum(value) over (partition by col) as value from {before})'
    return f'{half}, {name} as (select "row", col, value / sum(value) over (partition by "row") as value from {name}c)'


@query(f"""with m as (select l_suppkey % 7 as "row", l_linenumber as col, sum(l_quantity)::double as value from lineitem group by 1, 2), {_turn("a", "m")}, {_turn("b", "a")}, {_turn("c", "b")}
select "row", col, round(value, 9) as value from c""")
def balanced_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("row"), F.col("l_linenumber").alias("col")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return A.balance(matrix).withColumn("value", F.round("value", 9))


@query("select l_returnflag as name, l_suppkey as i, round(avg(l_quantity)::double, 9) as value, count(*) as n from lineitem where l_linenumber between 2 and 4 group by 1, 2")
def averaged_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("checkpoint"), F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("i"), F.col("l_quantity").alias("value"))
    return A.average_parameters(rows, 2, 4).withColumn("value", F.round(F.col("value").cast("double"), 9))


@query("select o_orderkey, o_orderkey - o_custkey as frame, case when o_orderkey >= o_custkey and o_orderkey - o_custkey < 5000 then o_orderkey - o_custkey end as checked from orders")
def source_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k, X.source_frame(k, c).alias("frame"), X.checked_source_frame(k, c, F.lit(5000)).alias("checked"))


@query("with e as (select o_orderkey % 13 as x, o_custkey % 17 as y, o_orderkey from orders) select o_orderkey, x between 2 and 12.9 and y > 2 and y <= 16.5 and (y - 2) / 14.5 <= 1 as inside from (select o_orderkey, x + 0.25 as x, y + 0.25 as y from e)")
def inside_court_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("o_orderkey") % 13).cast("double") + 0.25, (F.col("o_custkey") % 17).cast("double") + 0.25
    return table(spark, sf_dir, "orders").select("o_orderkey", X.inside_polygon(x, y, [(2.0, 2.0), (12.9, 2.0), (12.9, 16.5), (2.0, 16.5)]).alias("inside"))


@query(f"""with {DETECTIONS}, o as (select image, det, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1)) as share
  from det a join (select image, x1, y1, x2, y2 from det where label <> 'N') b using (image) where a.label = 'N') select distinct image, det from o where share >= 0.6""")
def covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir)
    return A.overlapping(boxes.where("label = 'N'"), boxes.where("label <> 'N'"), ["image"], 0.6).select("image", "det")


_POINT = "pt as (select o_orderkey, (o_orderkey % 19)::double as x, (o_custkey % 33)::double as y, (o_orderkey % 11)::double - 1 as z from orders)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k, (k % 19).cast("double").alias("x"), (c % 33).cast("double").alias("y"), ((k % 11).cast("double") - 1).alias("z"))


@query(f"with {_POINT} select o_orderkey, x between -2 and 17 and y between -2 and 30 and z between -0.75 and 8 as valid from pt")
def valid_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("o_orderkey", A.valid_ball(F.col("x"), F.col("y"), F.col("z")).alias("valid"))


@query(f"with {_POINT} select o_orderkey, cast(floor(x * 50 + 25) as integer) as px, cast(floor(y * 50) as integer) as py, x between 0 and 15 and y between 0 and 28 as inside from pt")
def court_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = X.court_pixel(F.col("x"), F.col("y"))
    return _points(spark, sf_dir).select("o_orderkey", px.alias("px"), py.alias("py"), X.in_court(F.col("x"), F.col("y")).alias("inside"))


@query(f"with {_POINT} select o_orderkey, case when (z - 5) ** 2 + 2 * 9.81::double * (y / 10 - 3.05::double) >= 0 then round((z - 5 + sqrt((z - 5) ** 2 + 2 * 9.81::double * (y / 10 - 3.05::double))) / 9.81::double, 9) end as seconds from pt")
def fall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("o_orderkey", F.round(X.fall_roots(F.col("y") / 10, F.col("z") - 5, 3.05), 9).alias("seconds"))


@query(f"""with {_POINT}, w as (select o_orderkey, x, y, z, 0.5::double * y + 0.1::double * x + 0.2::double * z - 3.05::double as w from pt)
select o_orderkey, case when w > 0 then round((10 * x + 2 * z + 1) / w, 9) end as u, case when w > 0 then round((10 * y - 3 * z + 2) / w, 9) end as v from w""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = X.project([F.col("x"), F.col("y"), F.col("z")], [[10.0, 0.0, 2.0, 1.0], [0.0, 10.0, -3.0, 2.0], [0.1, 0.5, 0.2, -3.05]])
    return _points(spark, sf_dir).select("o_orderkey", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 and o_custkey % 3 = 0 then 75 when o_orderkey % 2 = 0 and o_custkey % 5 = 0 then 65 when o_orderkey % 2 = 0 then 50 else 10 end as score from orders")
def highlight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k, X.highlight_score(k % 2 == 0, c % 3 == 0, c % 5 == 0).alias("score"))


@query(f"with {_POINT} select o_orderkey, case when x > 15 then 0.5 when x / 15 >= 0.75 then 0 when x / 15 <= 0.55 then 1 else round((0.75 - x / 15) / 0.2::double, 9) end::double as cost from pt")
def face_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("o_orderkey", F.round(X.face_cost(F.when(F.col("x") <= 15, F.col("x") / 15)), 9).cast("double").alias("cost"))


@query(f"""with {DETECTIONS} select image, det, (x1 + x2) / 2 - greatest(x2 - x1, y2 - y1) * 0.6::double as x1, (y1 + y2) / 2 - greatest(x2 - x1, y2 - y1) * 0.6::double as y1,
  (x1 + x2) / 2 + greatest(x2 - x1, y2 - y1) * 0.6::double as x2, (y1 + y2) / 2 + greatest(x2 - x1, y2 - y1) * 0.6::double as y2 from det""")
def square_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(detections(spark, sf_dir))
    return _flat(flat.select("image", "det", X.square_box(*map(F.col, _SIDES), grow=1.2).alias("box")))


@query("select p_partkey, 'a clip of ' || lower(p_brand) || ' in play' as prompt from part union all select p_partkey, lower(p_brand) from part")
def class_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.prompts(F.lower("p_brand"), ["a clip of {} in play", "{}"])).alias("prompt"))


@query(f"""with {PREDICTIONS}, e as (select sample, truth, label, exp(score) / sum(exp(score)) over (partition by sample) as p from pred)
select sample, round(-ln(p), 9) as entropy, round(-((1 - p) ** 2) * ln(p), 9) as focal from e where label = truth""")
def class_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = predictions(spark, sf_dir).groupBy("sample", "truth").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "score"))), lambda x: x["score"]).alias("scores"))
    return one.select("sample", F.round(X.cross_entropy(F.col("scores"), F.col("truth").cast("int")), 9).alias("entropy"), F.round(X.focal_loss(F.col("scores"), F.col("truth").cast("int")), 9).alias("focal"))


@query("""select p_partkey, round(case when p_size < 5 then 0.01::double + 0.09::double * p_size / 5 else 0.001::double + 0.099::double * (cos(pi() * (p_size - 5) / 55) + 1) / 2 end, 9) as cosine,
  round(case when p_size >= 40 then 0.001::double when p_size >= 20 then 0.01::double else 0.1::double end, 9) as step from part""")
def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.cosine_rate(epoch, 0.1, 0.001, 60, 5, 0.01), 9).alias("cosine"), F.round(X.step_rate(epoch, 0.1, [(20, 0.1), (40, 0.01)]), 9).alias("step"))


@query("""select p_partkey, i, case when i = p_size % 4 then 0.925::double else 0.025::double end as smooth, case when i in (p_size % 4, p_partkey % 4) then 1 else 0 end as held,
  round(case when i = p_size % 4 then 0.3::double else 0 end + case when i = p_partkey % 4 then 0.7::double else 0 end, 9) as mixed from part, range(0, 4) t(i)""")
def target_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("p_size") % 4).cast("int"), (F.col("p_partkey") % 4).cast("int")
    mixed = X.mix_targets(X.one_hot(a, 4), X.one_hot(b, 4), 0.3)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.arrays_zip(X.one_hot(a, 4, 0.1).alias("smooth"), X.binary_vector(F.array(a, b), 4).alias("held"), mixed.alias("mixed"))).alias("i", "x"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), F.round("x.smooth", 9).alias("smooth"), "x.held", F.round("x.mixed", 9).alias("mixed"))
