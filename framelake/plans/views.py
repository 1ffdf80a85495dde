"""Frame-indexed views of the sample tables, in DataFrames and in SQL.

The sample tables hold no recordings, so events stand for observations (one frame a minute), orders for an event
ledger, line items for detections. Every view exists twice, with the same columns and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = ("shot", "rebound", "steal", "block", "successful_drive", "assist_chain", "pass")


#: Boxes of one task.
BOXES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame, each: int) -> int:
    """How many tasks have about ``each`` rows of a table, so that tasks grow in number and not in size."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def dealt(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """``rows`` of a table dealt by ``keys``, about ``each`` to a task."""
    return rows.repartition(tasks(rows, each), *keys)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, track, kind, value, frame (whole minutes since 2024) of every event."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("track"), F.col("event_type").alias("kind"), "value", F.floor(micros / F.lit(60_000_000)).cast("long").alias("frame"))


OBSERVATIONS = "obs as (select event_id, user_id as track, event_type as kind, value, cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 60000000) as bigint) as frame from events)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event ledger with one row for each order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    status = F.when(k % 9 == 0, "uncertain").when(k % 10 == 1, "rejected").otherwise("confirmed")
    outcome = F.struct(F.when(k % 3 == 0, "made").when(k % 3 == 1, "missed").otherwise("unknown").alias("value"), F.when(k % 5 == 0, "uncertain").otherwise("confirmed").alias("status"))

    def actor(player: Column) -> Column:
        return F.struct(player.alias("player_id"), F.when(k % 4 == 0, "candidate").otherwise("confirmed").alias("role_status"), F.when(c % 6 == 0, "unknown").otherwise("confirmed").alias("identity_status"))

    p = F.concat(F.lit("p"), (c % 9).cast("string"))
    q = F.concat(F.lit("p"), ((c + 4) % 9).cast("string"))
    role = F.element_at(F.array(*map(F.lit, ("shooter", "rebounder", "stealer", "blocker", "driver", "passer", "passer"))), (k % len(KINDS) + 1).cast("int"))
    roles = F.when(kind == "pass", F.create_map(F.lit("passer"), actor(p), F.lit("receiver"), actor(q))).otherwise(F.create_map(role, actor(p)))
    zone = F.when(k % 4 == 0, "inside_arc").when(k % 4 == 1, "outside_arc")
    side = F.when(k % 2 == 0, "offensive").when(k % 8 == 1, "defensive")
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), kind.alias("type"), status.alias("status"), outcome.alias("outcome"), zone.alias("zone"), side.alias("side"), roles.alias("actor_roles"))


_P, _Q = "'p' || (o_custkey % 9)", "'p' || ((o_custkey + 4) % 9)"
LEDGER = f"""led as (select o_orderkey as event_id, ['shot','rebound','steal','block','successful_drive','assist_chain','pass'][o_orderkey % 7 + 1] as type,
  case when o_orderkey % 9 = 0 then 'uncertain' when o_orderkey % 10 = 1 then 'rejected' else 'confirmed' end as status,
  case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 'made' when o_orderkey % 3 = 1 then 'missed' else 'unknown' end as outcome,
  case when o_orderkey % 4 = 0 then 'inside_arc' when o_orderkey % 4 = 1 then 'outside_arc' end as zone,
  case when o_orderkey % 2 = 0 then 'offensive' when o_orderkey % 8 = 1 then 'defensive' end as side,
  {_P} as p, {_Q} as q, o_orderkey % 4 <> 0 and o_custkey % 6 <> 0 as sure from orders),
rol as (select *, case type when 'shot' then 'shooter' when 'rebound' then 'rebounder' when 'steal' then 'stealer' when 'block' then 'blocker' when 'successful_drive' then 'driver' else 'passer' end as role, p as actor from led
  union all select *, 'receiver' as role, q as actor from led where type = 'pass')"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: one for each line item, by order (image); det numbers them within the image."""
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    x, y = F.col("l_partkey") % 10, F.col("l_suppkey") % 10
    box = F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 5 + q / 5).cast("double").alias("x2"), (y + 5 + n * 2).cast("double").alias("y2"))
    det = F.row_number().over(Window.partitionBy("image").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    # The image is named first: rows then count as dealt by it.
    rows = dealt(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image"), BOXES, "image")
    return rows.select("image", det.alias("det"), F.col("l_extendedprice").alias("score"), box.alias("box"), F.col("l_returnflag").alias("label"))


DETECTIONS = """det as (select l_orderkey as image, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as det, l_extendedprice as score, l_returnflag as label,
  cast(l_partkey % 10 as double) as x1, cast(l_suppkey % 10 as double) as y1, l_partkey % 10 + 5 + l_quantity / 5 as x2, l_suppkey % 10 + 5 + l_linenumber * 2.0::double as y2 from lineitem)"""


def overlap_sql(a: str, b: str) -> str:
    """IoU of the boxes of two SQL aliases."""
    inter = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    size = "greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0)"
    return f"coalesce({inter} / nullif({size.format(a)} + {size.format(b)} - {inter}, 0), 0)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of five classes for every part: sample, label, score, truth."""
    label = F.explode(F.sequence(F.lit(0), F.lit(4)))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_size") % 5).alias("truth"), label.alias("label"))
    return parts.withColumn("score", ((F.col("sample") * 7 + F.col("label") * 13 + F.col("sample") * F.col("label")) % 101) / F.lit(101.0))


PREDICTIONS = "pred as (select sample, truth, label, ((sample * 7 + label * 13 + sample * label) % 101) / 101.0::double as score from (select p_partkey as sample, p_size % 5 as truth, unnest(range(0, 5))::integer as label from part))"
