"""Queries of shots, plan checks and summaries over the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import integrity as C
from framelake.operators import shots as H
from framelake.operators import summaries as U

from .registry import query
from .views import LEDGER, OBSERVATIONS, ledger, observations, table

FPS = 30.0


# ---- shots: four segments, frames within 20,000, views a and b ----

_SAMPLES = """smp as (select distinct c as segment, 'ab'[v] as view, s + d as frame, ((s + d) * (3 + v) % 97)::double as x, ((s + d) * 7 % 89)::double as y
  from (select o_orderkey % 4 as c, o_orderkey % 5000 * 4 as s from orders) o, range(0, 14) r(d), range(1, 3) t(v) where (s + d) % 23 <> 0)"""
_RIMS = "rim as (select i as segment, v as view, 90.0::double as cx, 10.0::double as cy, 40.0::double as width from range(0, 4) t(i), (values ('a'), ('b')) u(v))"
_SPANS = """spn as (select distinct o_orderkey % 4 as segment, 'p' || (o_custkey % 9) as owner, o_orderkey % 5000 * 4 as start, o_orderkey % 5000 * 4 + 10 + o_custkey % 30 as "end", case when o_custkey % 9 < 8 then o_custkey % 2 end as team from orders)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.col("o_custkey").alias("c"), (k % 4).alias("segment"), (k % 5000 * 4).alias("at"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("segment", F.explode(F.sequence(F.col("at"), F.col("at") + 13)).alias("frame"))
    rows = rows.select("segment", "frame", F.explode(F.array(F.lit(1), F.lit(2))).alias("v")).where("frame % 23 <> 0").distinct()
    return rows.select("segment", F.when(F.col("v") == 1, "a").otherwise("b").alias("view"), "frame", (F.col("frame") * (F.col("v") + 3) % 97).cast("double").alias("x"), (F.col("frame") * 7 % 89).cast("double").alias("y"))


def _rims(spark: SparkSession) -> DataFrame:
    rows = spark.range(4).select(F.col("id").alias("segment"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("view"))
    return rows.select("segment", "view", F.lit(90.0).alias("cx"), F.lit(10.0).alias("cy"), F.lit(40.0).alias("width"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return _orders(spark, sf_dir).select("segment", F.concat(F.lit("p"), (c % 9).cast("string")).alias("owner"), F.col("at").alias("start"), (F.col("at") + 10 + c % 30).alias("end"), F.when(c % 9 < 8, c % 2).alias("team")).distinct()


def _contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _orders(spark, sf_dir).select("segment", F.concat(F.lit("p"), (F.col("c") % 9).cast("string")).alias("player"), F.col("at").alias("frame"), (F.col("c") % 9).alias("n")).distinct()
    wrist = F.when(F.col("n") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("n") * 10).cast("double"))

    def joint(y: Column) -> Column:
        return F.struct(F.lit(1.0).alias("x"), y.alias("y"), F.lit(0.9).alias("confidence"))

    body = F.array(*[joint(wrist if i == 9 else F.lit(45.0)) for i in range(17)])
    poses = rows.withColumn("keypoints", body).select("segment", "frame", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("view"), "player", "keypoints")
    return rows.drop("n"), poses


_RELEASES = f"""{_SAMPLES}, {_RIMS},
up as (select distinct o_orderkey % 4 as segment, 'p' || (o_custkey % 9) as player, o_orderkey % 5000 * 4 as frame, v as view from orders, (values ('a'), ('b')) t(v) where o_custkey % 9 in (1, 2, 4)),
sn as (select up.*, smp.frame as seen, x, y, smp.frame - lag(smp.frame) over (partition by up.segment, player, up.frame, up.view order by smp.frame) as hole from up join smp on up.segment = smp.segment and up.view = smp.view and smp.frame between up.frame and up.frame + 12),
fl as (select segment, player, frame, view, count(*) as n, max(hole) as hole, min(seen) as a, max(seen) as b, arg_min(x, seen) as ax, arg_min(y, seen) as ay, arg_max(x, seen) as bx, arg_max(y, seen) as "by" from sn group by all),
rel as (select segment, player, frame, view from fl join rim using (segment, view) where n >= 3 and b - a >= 3 and hole <= 3.000001
  and (cx - ax) * (bx - ax) + (cy - ay) * ("by" - ay) > 0.5 * sqrt((cx - ax) ** 2 + (cy - ay) ** 2) * sqrt((bx - ax) ** 2 + ("by" - ay) ** 2)
  and sqrt((bx - ax) ** 2 + ("by" - ay) ** 2) * sqrt((cx - ax) ** 2 + (cy - ay) ** 2) > 0 and sqrt((cx - ax) ** 2 + (cy - ay) ** 2) - sqrt((cx - bx) ** 2 + (cy - "by") ** 2) > 0.4 * width)"""


@query(f"with {_RELEASES} select * from rel")
def shot_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts, poses = _contacts(spark, sf_dir)
    return H.release_views(contacts, poses, _samples(spark, sf_dir), _rims(spark), FPS)


@query(f"""with {_SPANS}, brf as (select distinct segment, owner, start + n as start, start + n + 1 + ("end" - start) % 2 as "end", case when n < 8 then n % 2 end as team from (select *, cast(substr(owner, 2) as integer) as n from spn)),
h as (select *, lag(owner) over w as passer, lag("end") over w as let, lag(team) over w as t0 from brf window w as (partition by segment order by start, "end", owner)),
sh as (select segment, start * 10 + cast(substr(owner, 2) as integer) as event_id, start + 1 as release, owner as player from brf),
l as (select sh.segment, event_id, release, player, arg_max(struct_pack(owner, start, team, passer, let, t0), struct_pack(a := start, b := "end", c := owner)) as c from sh join h on sh.segment = h.segment and h.start between release - 45 and release group by all)
select segment, event_id, c.passer as passer, player as receiver, c.let - 1 as frame from l where c.owner = player and c.passer <> player and c.team = c.t0 and c.start - c.let between 0 and 45
  and not exists (select 1 from (select o_orderkey % 4 as s, o_orderkey % 5000 * 4 as f from orders where o_custkey % 5 = 0) e where e.s = l.segment and e.f >= c.let and e.f < c.start)""")
def shot_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, length = F.substring("owner", 2, 1).cast("int"), F.col("end") - F.col("start")
    spans = _spans(spark, sf_dir).select("segment", "owner", (F.col("start") + n).alias("start"), (F.col("start") + n + 1 + length % 2).alias("end"), F.when(n < 8, n % 2).alias("team"))
    shots = spans.select("segment", (F.col("start") * 10 + F.substring("owner", 2, 1).cast("int")).alias("event_id"), (F.col("start") + 1).alias("release"), F.col("owner").alias("player"))
    return H.passes_before(shots, spans, _orders(spark, sf_dir).where("c % 5 = 0").select("segment", F.col("at").alias("anchor")), FPS)


def _visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    visits = _orders(spark, sf_dir).where("c % 4 = 1").select("segment", F.col("at").alias("begin")).distinct()
    visits = visits.select("segment", F.col("begin").alias("visit"), "begin", (F.col("begin") + 9).alias("end"))
    passages = _orders(spark, sf_dir).where("c % 3 = 1").select("segment", (F.col("at") + 2.5).alias("crossing")).distinct()
    return visits, passages


_TRACKS = """trk as (select segment, f as frame, 'ab'[v] as view, 'p' || p as track, ((f * (p + 2) + v * 11) % 83)::double as x, ((f * (p + 5)) % 79)::double as y
  from (select segment, start as f from spn union select segment, "end" - 1 from spn) s, range(0, 9) r(p), range(1, 3) t(v) where (f + p) % 4 <> 0)"""


@query(f"""with {_SPANS}, {_TRACKS}, {_RIMS}, r as (select s.segment, s.owner, s.start, s."end", p0.view, d0.track as defender
  from spn s join trk p0 on p0.segment = s.segment and p0.frame = s.start and p0.track = s.owner join trk p1 on p1.segment = s.segment and p1.frame = s."end" - 1 and p1.track = s.owner and p1.view = p0.view
  join rim on rim.segment = s.segment and rim.view = p0.view join trk d0 on d0.segment = s.segment and d0.frame = s.start and d0.view = p0.view and d0.track <> s.owner
  join trk d1 on d1.segment = s.segment and d1.frame = s."end" - 1 and d1.view = p0.view and d1.track = d0.track
  where s."end" - s.start >= 20 and sqrt((p0.x - cx) ** 2 + (p0.y - cy) ** 2) - sqrt((p1.x - cx) ** 2 + (p1.y - cy) ** 2) >= 0.55 * width
  and sqrt((d0.x - cx) ** 2 + (d0.y - cy) ** 2) < sqrt((p0.x - cx) ** 2 + (p0.y - cy) ** 2) and sqrt((d0.x - p0.x) ** 2 + (d0.y - p0.y) ** 2) < 1.8 * width
  and sqrt((p1.x - cx) ** 2 + (p1.y - cy) ** 2) + 0.3 * width < sqrt((d1.x - cx) ** 2 + (d1.y - cy) ** 2)),
n as (select segment, owner, start, "end", view, min(defender) as defender from r group by all), v as (select segment, owner, start, "end", defender, count(*) as views from n group by all)
select segment, owner, start, "end", defender, views, 'uncertain' as status from v qualify row_number() over (partition by segment, owner, start, "end" order by views desc, defender) = 1""")
def drive_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).drop("team").distinct()
    frames = spans.select("segment", F.col("start").alias("f")).union(spans.select("segment", F.col("end") - 1)).distinct()
    rows = frames.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).where("(f + p) % 4 <> 0")
    f, p, v = F.col("f"), F.col("p"), F.col("v")
    tracks = rows.select("segment", f.alias("frame"), F.when(v == 1, "a").otherwise("b").alias("view"), F.concat(F.lit("p"), p.cast("string")).alias("track"), ((f * (p + 2) + v * 11) % 83).cast("double").alias("x"), ((f * (p + 5)) % 79).cast("double").alias("y"))
    return H.drive_proposals(spans, tracks, _rims(spark), FPS)


# ---- checks of plans ----


@query(f"with {LEDGER} select event_id, type from rol where sure and actor = 'p3' and type <> 'pass'")
def events_of_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where(C.played_by(F.lit("p3"))).select("event_id", "type")


@query("select distinct o_custkey as id from orders where o_orderkey % 9 <> 0 and o_custkey not in (select l_suppkey from lineitem)")
def missing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_custkey").alias("id"))
    return C.missing(required, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")), ["id"])


@query("""select id, 'left' as side from (select o_custkey as id from orders except select l_partkey from lineitem)
union all select id, 'right' from (select l_partkey as id from lineitem except select o_custkey from orders)""")
def unequal_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return C.unequal(left, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")), ["id"])


@query("select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def repeated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


_CUTS = "cut as (select distinct l_orderkey as clip, l_linenumber * 10 as start, l_linenumber * 10 + 10 - case when l_partkey % 4 = 0 then 1 else 0 end as \"end\" from lineitem)"


@query(f"""with {_CUTS} select * from (select clip, start, "end", lag("end") over (partition by clip order by start, "end") as last_end from cut) where last_end <> start""")
def broken_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 10
    shots = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), start.alias("start"), (start + 10 - F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0)).alias("end"))
    return C.broken_cuts(shots.distinct())


@query("""select clip, frame from (select o_orderkey as clip, unnest([o_orderkey + o_custkey % 60, o_orderkey - 1 + o_custkey % 3]) as frame from orders) where frame < clip or frame >= clip + 50""")
def frames_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    clips = table(spark, sf_dir, "orders").select(k.alias("clip"), k.alias("start"), (k + 50).alias("end"), F.array(k + c % 60, k - 1 + c % 3).alias("critical_frames"))
    return C.outside(clips).select("clip", "frame")


@query("""select coalesce(a.k, b.k) as k from (select c_custkey as k, c_nationkey as v from customer where c_custkey % 7 <> 0) a full join (select c_custkey as k, case when c_custkey % 5 = 0 then null else c_nationkey end as v from customer where c_custkey % 11 <> 0) b on a.k = b.k
where a.k is null or b.k is null or a.v is distinct from b.v""")
def changed_calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return C.differing(rows.where("k % 7 <> 0"), rows.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v"))), ["k"])


# ---- summaries ----


@query("""select o_orderkey as frame, (o_orderkey % 19)::double as x, greatest(coalesce(n, 0), 2) as views from orders left join (select l_orderkey as k, count(distinct l_suppkey % 6) as n from lineitem group by 1) s on s.k = o_orderkey
where o_custkey % 5 <> 0 and o_custkey % 4 <> 0""")
def ball_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, x = F.col("o_custkey"), (F.col("o_orderkey") % 19).cast("double")
    balls = table(spark, sf_dir, "orders").select(F.lit(0).alias("segment"), F.col("o_orderkey").alias("frame"), x.alias("x"), x.alias("y"), F.when(c % 5 == 0, float("nan")).otherwise(x).alias("z"), (c % 4 == 0).alias("predicted"))
    seen = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("segment"), F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 6).alias("view"))
    return U.ball_measurements(balls, seen).select("frame", "x", "views")


@query(f"""with {OBSERVATIONS}, g as (select kind as segment, event_id as frame, value > 30 as observed, value > 95 as outlier, track % 2 = 0 as filled, track % 4 <> 0 as known, case track % 3 when 0 then 'flight' when 1 then 'held' end as state from obs),
h as (select *, not observed and not outlier and known as hole from g), i as (select *, hole and not coalesce(lag(hole) over w, false) as first from h window w as (partition by segment order by frame)),
j as (select *, case when hole then sum(first::integer) over (partition by segment order by frame rows unbounded preceding) end as gap from i),
k as (select segment, gap, count(*) as n, count(*) filter (filled) as filled from j where hole group by all)
select g.segment, min(frame) as first_frame, max(frame) as last_frame, count(*) as total_frames, count(*) filter (observed) as observed_frames, count(*) filter (outlier) as outlier_count, round(avg(known::integer), 4) as coverage,
  any_value(m.c) as gap_count, any_value(m.f) as gap_frames_filled, any_value(m.l) as longest_gap_frames, count(*) filter (state = 'flight') as flight_frames, count(*) filter (state = 'held') as held_frames
from g join (select segment, count(*) as c, cast(sum(filled) as bigint) as f, max(n) as l from k group by segment) m using (segment) group by g.segment""")
def trajectory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("track")
    grid = observations(spark, sf_dir).select(F.col("kind").alias("segment"), F.col("event_id").alias("frame"), (F.col("value") > 30).alias("observed"), (F.col("value") > 95).alias("outlier"), (t % 2 == 0).alias("filled"), (t % 4 != 0).alias("known"), F.when(t % 3 == 0, "flight").when(t % 3 == 1, "held").alias("state"))
    return U.trajectory_stats(grid)


@query(f"""with {OBSERVATIONS} select count(distinct frame) as multiview_frames, count(*) as poses, count(*) filter (value > 80) as predicted_poses, count(distinct frame) filter (kind = 'click') as ball_frames,
  count(*) filter (kind = 'click' and value <= 80) as ball_observed_frames, round(count(distinct frame) / 12.5::double, 3) as fps, null::double as slot_utilization from obs""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("predicted", F.col("value") > 80)
    return U.run_metrics(obs, obs.where("kind = 'click'"), F.lit(12.5), F.lit(0))


@query("""with t as (select distinct l_returnflag as label, l_orderkey as image from lineitem where l_quantity > 25 and l_returnflag <> 'A'), h as (select distinct l_returnflag as label, l_orderkey as image from lineitem where l_linenumber % 3 = 0)
select label, count(t.image) as n_images, count(t.image) filter (h.image is not null) as n_correct, case when count(t.image) = 0 then 'nan'::double else count(t.image) filter (h.image is not null) / count(t.image) end as corloc
from t full join h using (label, image) group by label""")
def correct_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("image"), "l_quantity", "l_linenumber")
    return U.correct_localisation(rows.where("l_quantity > 25 and label <> 'A'"), rows.where("l_linenumber % 3 = 0"))


@query("select r_name as parent, coalesce(string_agg(n_nationkey::varchar, ',' order by n_nationkey) filter (n_nationkey % 5 <> 0), '') as ids from nation join region on n_regionkey = r_regionkey group by r_name")
def class_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    families = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("child"))
    classes = nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return U.class_parents(families, classes).select("parent", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("select n_nationkey as position, n_name as name, n_nationkey as id from nation where n_nationkey % 5 <> 0")
def class_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"))
    return U.class_subset(names, nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))).select("position", "name", "id")


@query("""with e as (select vec_id, cast(embedding as double[]) as v, case when vec_id % 3 = 0 then 0 else 1 end::double as s from embeddings), w as (select vec_id, list_concat(list_transform(v, lambda a: a * s), v, list_reverse(v)) as v, s from e)
select a.vec_id, round(1 - case when a.s = 1 and b.s = 1 then list_cosine_similarity(a.v, b.v) else list_cosine_similarity(a.v[65:], b.v[65:]) end, 9) as distance from w a join w b on b.vec_id = a.vec_id + 1""")
def appearance_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = F.col("embedding").cast("array<double>"), F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.transform(v, lambda a: a * s), v, F.reverse(v)).alias("v"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")
    return pairs.select("vec_id", F.round(U.appearance_distance(F.col("v"), F.col("u")), 9).alias("distance"))


@query("""with p as (select o_orderkey, (o_orderkey % 19)::double as x, (o_custkey % 33)::double as y, (o_orderkey % 11)::double as z, o_orderkey % 2 = 0 as l, o_custkey % 2 = 0 as r, o_orderkey % 5 <> 0 as s from orders)
select o_orderkey, case when l and r then x + 9.5 when l then x + 9 when r then x + 10 when s then x + 5.5 end as x, case when l and r or l or r or s then y end as y, case when l or r then z when s then z - 0.3::double end as z from p""")
def hand_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    there = {9: k % 2 == 0, 10: c % 2 == 0, 5: k % 5 != 0, 6: k % 5 != 0}

    def joint(i: int) -> Column:
        z = (k % 11).cast("double")
        return F.struct((k % 19 + i).cast("double").alias("x"), (c % 33).cast("double").alias("y"), F.when(there.get(i, F.lit(True)), z).otherwise(float("nan")).alias("z"))

    rows = table(spark, sf_dir, "orders").select("o_orderkey", U.hand_point(F.array(*map(joint, range(17)))).alias("p"))
    return rows.select("o_orderkey", "p.x", "p.y", "p.z")


@query(f"""with {OBSERVATIONS}, n as (select kind as segment, event_id as packet, value > 50 as overlap, row_number() over (partition by kind order by event_id) - 1 as nth from obs) select segment, packet, overlap from n where nth % 15 = 0 or (overlap and nth % 4 = 0)""")
def gallery_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.refreshes(observations(spark, sf_dir).select(F.col("kind").alias("segment"), F.col("event_id").alias("packet"), (F.col("value") > 50).alias("overlap")), 15, 4)


@query(f"""with {OBSERVATIONS}, p as (select kind as segment, event_id as frame, value / 30 as z, track % 6 = 0 as bad, row_number() over (partition by kind order by event_id) as i from obs),
h as (select *, case when i - lag(i) over (partition by segment order by frame) <= 6 then 0 else 1 end as new from p where z > 1.5::double), r as (select *, sum(new) over (partition by segment order by frame rows unbounded preceding) as run from h),
s as (select segment, run, min(frame) as start, max(frame) as "end" from r group by all), q as (select s.*, max(z) as peak from s join p on p.segment = s.segment and frame between start and "end" and not bad group by all having count(*) >= 5),
f as (select distinct kind as segment, event_id as s, event_id + 11 as e from obs where track % 40 = 1),
c as (select q.segment, run, sum(greatest(least("end", e) - greatest(start, s) + 1, 0)) as covered from q join f on f.segment = q.segment and s <= "end" and e >= start group by all)
select q.segment, start, "end", peak from q left join c using (segment, run) where "end" - start >= 5 and peak >= 2.2 and coalesce(covered, 0) < 0.5 * ("end" - start + 1)""")
def high_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    points = obs.select(F.col("kind").alias("segment"), F.col("event_id").alias("frame"), (F.col("value") / 30).alias("z"), (F.col("track") % 6 == 0).alias("outlier"))
    flights = obs.where("track % 40 = 1").select(F.col("kind").alias("segment"), F.col("event_id").alias("start"), (F.col("event_id") + 11).alias("end"))
    return U.high_runs(points, flights)
