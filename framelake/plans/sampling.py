"""Queries of ground positions, motion visits, trails and samples of frames over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import evaluation as V
from framelake.operators import sequences as S
from framelake.operators import statistics as T

from .detail import _SAMPLES, FPS, _samples
from .registry import query
from .views import OBSERVATIONS, observations, table


@query(f"""with {OBSERVATIONS}, r as (select kind as segment, frame // 60 as frame, track % 10 as track, value as x, (value * (track % 7)) % 50 as y, event_id % 5 = 0 as predicted, event_id % 4 as views, (event_id % 50)::double as error from obs),
s as (select * from r where not predicted and views >= 2 and error < 30), a as (select distinct segment, track, frame from r)
select a.segment, a.track, a.frame, round(median(x), 9) as x, round(median(y), 9) as y, count(*) as n from a join s on s.segment = a.segment and s.track = a.track and s.frame between a.frame - 2 and a.frame + 2 group by all having count(*) >= 3""")
def ground_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t, v = F.col("event_id"), F.col("track"), F.col("value")
    rows = observations(spark, sf_dir).select(
        F.col("kind").alias("segment"), F.floor(F.col("frame") / 60).alias("frame"), (t % 10).alias("track"), v.alias("x"), (v * (t % 7) % 50).alias("y"),
        (e % 5 == 0).alias("predicted"), (e % 4).alias("views"), (e % 50).cast("double").alias("error"),
    )
    found = T.ground_positions(rows, rows)
    return found.select("segment", "track", "frame", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n")


@query(f"""with {OBSERVATIONS}, m as (select kind, event_id // 7 as frame, max(case when event_id % 97 < 9 then value / 400 else value / 4000 end) as motion from obs group by all),
u as (select *, motion / greatest(coalesce(median(motion) over (partition by kind order by frame rows between 90 preceding and 1 preceding), 0.01), 0.006) as relative from m),
h as (select * from u where motion >= 0.025 and relative >= 1.8),
n as (select *, case when frame - lag(frame) over (partition by kind order by frame) <= 7 then 0 else 1 end as new from h),
r as (select *, sum(new) over (partition by kind order by frame) as run from n)
select kind, min(frame) as start, max(frame) + 1 as "end", arg_max(frame, struct_pack(a := relative, b := -frame)) as peak, round(max(relative), 9) as relative from r group by kind, run having max(frame) + 1 - min(frame) >= 2""")
def motion_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    motion = observations(spark, sf_dir).groupBy("kind", F.floor(e / 7).alias("frame")).agg(F.max(F.when(e % 97 < 9, v / 400).otherwise(v / 4000)).alias("motion"))
    found = S.motion_visits(motion, ["kind"], FPS)
    return found.select("kind", "start", "end", "peak", F.round("relative", 9).alias("relative"))


@query(f"""with {_SAMPLES}, a as (select distinct segment, view, frame from smp where frame % 20 = 0),
p as (select a.segment, a.view, a.frame, s.frame as at_, x, y from a join smp s on s.segment = a.segment and s.view = a.view and s.frame between a.frame - 24 and a.frame where s.frame % 5 <> 1 and s.frame % 19 > 3),
n as (select *, case when at_ - lag(at_) over w <= 3 then 0 else 1 end as new from p window w as (partition by segment, view, frame order by at_)),
r as (select *, sum(new) over (partition by segment, view, frame order by at_) as piece from n)
select segment, view, frame, cast(piece as bigint) as piece, count(*) as points, min(at_) as first, max(at_) as last, sum(x + y) as total from r group by segment, view, frame, piece""")
def ball_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls = _samples(spark, sf_dir)
    points = balls.where("frame % 5 <> 1 and frame % 19 > 3").select("segment", "view", F.col("frame").alias("at"), "x", "y", F.lit(1.0).alias("z"))
    found = S.trails(points, balls.where("frame % 20 = 0"), ["segment", "view"], 25, 2)
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"] + p["y"])
    return found.select("segment", "view", "frame", "piece", F.size("points").cast("long").alias("points"), F.col("points")[0]["at"].alias("first"), F.element_at("points", -1)["at"].alias("last"), total.alias("total"))


@query("""with v as (select p_partkey as sample, p_size * 3 as length, unnest(range(0, 4)) as view from part),
s as (select *, cast(round_even(greatest(length - 29, 0) / 3.0::double * view, 0) as bigint) as start from v)
select sample, view, i, greatest(least(start + i * 4, length - 1), 0) as frame from s, range(0, 8) t(i)""")
def strided_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_size") * 3).cast("long").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("view"))
    frames = videos.select("sample", "view", F.posexplode(S.strided_sample(F.col("length"), 8, 4, F.col("view"), 4)).alias("i", "frame"))
    return frames.withColumn("i", F.col("i").cast("long"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, track, frame, view, score, begin and last of observations, as pictures of a track."""
    e = F.col("event_id")
    rows = observations(spark, sf_dir).select("kind", (F.col("track") % 5).alias("track"), F.col("frame"), F.when(e % 3 == 0, "a").when(e % 3 == 1, "b").otherwise("c").alias("view"), F.floor("value").cast("long").alias("score"))
    spans = rows.groupBy("kind", "track").agg(F.min("frame").alias("begin"), F.max("frame").alias("last"))
    return rows.groupBy("kind", "track", "frame", "view").agg(F.max("score").alias("score")).join(spans, ["kind", "track"])


@query()
def stratified_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stratified_sample(pictures(spark, sf_dir), ["kind", "track"])


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of an earlier and a later run: purchases, and clicks, by kind of track."""
    obs = observations(spark, sf_dir).select((F.col("track") % 7).alias("group"), "kind", F.col("event_id").alias("name"), F.floor(F.col("frame") / 5).alias("at"))
    old = obs.where("kind = 'purchase'").select("group", F.col("name").alias("before"), "at")
    return old, obs.where("kind = 'click'").select("group", F.col("name").alias("after"), "at")


@query()
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.compare_runs(*two_runs(spark, sf_dir), ["group"], 30)
