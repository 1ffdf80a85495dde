"""Queries of the event, evaluation, trajectory and scalar operators over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import scalar as X
from framelake.operators import evaluation as E
from framelake.operators import events as V
from framelake.operators import ranking as R
from framelake.operators import sequences as S
from framelake.operators import space as P
from framelake.operators import statistics as T
from framelake.operators import trajectory as J
from framelake.streaming import stateful

from .registry import query
from .views import LEDGER, OBSERVATIONS, detections, ledger, observations, table

FPS = 30.0


def _balls(obs: DataFrame, kind: str) -> DataFrame:
    rows = obs.where(F.col("kind") == kind).select(F.col("track").alias("segment"), F.floor(F.col("frame") / 60).alias("frame"), F.lit("a").alias("view"), "value", "event_id")
    return rows.groupBy("segment", "frame", "view").agg(F.min_by(F.struct("value", "event_id"), "event_id").alias("m")).select("segment", "frame", "view", F.col("m.value").alias("x"), (F.col("m.value") + 1).alias("y"), (F.col("m.value") / 100).alias("confidence"))


_BALLS = "select track as segment, cast(frame // 60 as bigint) as frame, 'a' as view, arg_min(value, event_id) as x, arg_min(value, event_id) / 100 as confidence from obs where kind = '{}' group by track, frame // 60"


@query(f"with {OBSERVATIONS}, p as ({_BALLS.format('click')}), s as ({_BALLS.format('view')}), m as (select segment, frame, view, case when p.x is not null then p.x else s.x end as x, case when p.x is not null then p.confidence else s.confidence end as confidence from p full join s using (segment, frame, view)) select segment, frame, view, x, confidence from m where confidence >= 0.16")
def ball_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return V.overlay(_balls(obs, "click"), _balls(obs, "view"), 0.16).select("segment", "frame", "view", "x", "confidence")


@query(f"""with {OBSERVATIONS}, d as (select frame // 1440 as segment, frame // 20 as frame, cast(track as varchar) as track, min(value) / 1000 as distance from obs group by frame // 1440, frame // 20, track),
r as (select *, row_number() over w as n, lead(distance) over w as next from d window w as (partition by segment, frame order by distance, track))
select segment, frame, track as owner from r where n = 1 and (next is null or next - distance > 0.03)""")
def frame_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = observations(spark, sf_dir).groupBy(F.floor(F.col("frame") / 1440).alias("segment"), F.floor(F.col("frame") / 20).alias("frame"), F.col("track").cast("string").alias("track")).agg((F.min("value") / 1000).alias("distance"))
    return V.frame_owners(d)


@query()
def control_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    seen = obs.groupBy(F.col("kind").alias("segment"), F.floor(F.col("frame") / 20).alias("frame")).agg((F.min("track") % 3).cast("string").alias("owner"))
    return V.control_spans(seen.select("segment", "frame"), seen, FPS)


_CONTROLS = "con as (select kind as segment, cast(track as varchar) as owner, frame as start, frame + 20 + event_id % 30 as \"end\", case when track % 3 <> 0 then track % 3 end as team from obs)"


def _controls(obs: DataFrame) -> DataFrame:
    return obs.select(F.col("kind").alias("segment"), F.col("track").cast("string").alias("owner"), F.col("frame").alias("start"), (F.col("frame") + 20 + F.col("event_id") % 30).alias("end"), F.when(F.col("track") % 3 != 0, F.col("track") % 3).alias("team"))


@query(f"""with {OBSERVATIONS}, {_CONTROLS}, a as (select *, case when owner = lag(owner) over w and start - lag("end") over w <= 15 then 0 else 1 end as new from con window w as (partition by segment order by start, "end", owner)),
b as (select *, sum(new) over (partition by segment order by start, "end", owner rows unbounded preceding) as part from a)
select segment, owner, min(start) as start, max("end") as "end" from b group by segment, owner, part""")
def merged_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.merge_controls(_controls(observations(spark, sf_dir)).drop("team"), FPS)


@query(f"""with {OBSERVATIONS}, {_CONTROLS}, p as (select segment, owner, "end", lead(owner) over w as next_owner, lead(start) over w as next_start from con window w as (partition by segment order by start, "end", owner))
select segment, owner, next_owner, next_start - "end" as gap from p where owner <> next_owner and next_start - "end" between -6 and 36""")
def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transfers(_controls(observations(spark, sf_dir)), -6, 36).select("segment", "owner", "next_owner", "gap")


@query(f"""with {OBSERVATIONS}, {_CONTROLS}, mk as (select kind as segment, frame as anchor from obs where value > 80),
l as (select *, lag("end") over w as last_end, lag(team) over w as last_team from con window w as (partition by segment order by start, "end", owner)),
n as (select *, case when team = last_team and start - last_end between 0 and 36 and not exists (select 1 from mk where mk.segment = l.segment and l.last_end <= mk.anchor and mk.anchor < l.start) then 0 else 1 end as new from l)
select segment, owner, start, "end", cast(sum(new) over (partition by segment order by start, "end", owner rows unbounded preceding) as bigint) as possession from n""")
def possession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    makes = obs.where("value > 80").select(F.col("kind").alias("segment"), F.col("frame").alias("anchor"))
    return V.possession_ids(_controls(obs), makes, FPS).select("segment", "owner", "start", "end", "possession")


_LINKS = "pa as (select frame // 1440 as segment, event_id as pass_id, frame as passed, track as passer, (track * 7 + event_id) % 150 as receiver from obs where kind = 'click'), sh as (select frame // 1440 as segment, event_id, frame as anchor, track as shooter, value as worth from obs where kind = 'purchase')"


def _links(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    day = F.floor(F.col("frame") / 1440).alias("segment")
    passes = obs.where("kind = 'click'").select(day, "event_id", F.col("frame").alias("anchor"), F.col("track").alias("passer"), ((F.col("track") * 7 + F.col("event_id")) % 150).alias("receiver"))
    shots = obs.where("kind = 'purchase'").select(day, "event_id", F.col("frame").alias("anchor"), F.col("track").alias("shooter"), F.col("value").alias("worth"))
    return passes, shots


@query(f"""with {OBSERVATIONS}, {_LINKS}, c as (select sh.segment, sh.event_id, pa.pass_id, pa.passer, pa.passed, sh.anchor, pa.receiver from sh join pa on sh.segment = pa.segment and pa.receiver = sh.shooter and pa.passed between sh.anchor - 1200 and sh.anchor
  where not exists (select 1 from sh o where o.segment = sh.segment and o.event_id <> sh.event_id and o.worth > 90 and pa.passed < o.anchor and o.anchor < sh.anchor)
  and not exists (select 1 from obs k where k.kind = 'error' and k.value > 90 and k.frame // 1440 = sh.segment and pa.passed < k.frame and k.frame < sh.anchor and k.track <> pa.receiver)),
r as (select *, row_number() over (partition by event_id order by passed desc, pass_id desc) as n from c) select segment, event_id, pass_id, passer, passed from r where n = 1""")
def assist_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    passes, shots = _links(obs)
    controls = obs.where("kind = 'error' and value > 90").select(F.floor(F.col("frame") / 1440).alias("segment"), F.col("track").alias("owner"), F.col("frame").alias("start"))
    return V.assists(passes, shots, shots.where("worth > 90"), controls, 300.0)


@query(f"with {OBSERVATIONS}, {_LINKS}, r as (select pa.segment, pa.pass_id as event_id, sh.event_id as to_score, row_number() over (partition by pa.pass_id order by sh.anchor, sh.event_id) as n from pa join sh on sh.segment = pa.segment and sh.shooter = pa.passer and sh.anchor between pa.passed and pa.passed + 1200) select segment, event_id, to_score from r where n = 1")
def to_score_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes, shots = _links(observations(spark, sf_dir))
    return V.follow_ups(passes.withColumnRenamed("passer", "shooter"), shots, "shooter", 40.0, FPS, "to_score")


@query(f"""with {OBSERVATIONS} select v.event_id as visit, v.track as segment, v.frame as peak from obs v where v.kind = 'view' and not exists (select 1 from obs s where s.kind = 'purchase' and s.track = v.track and (abs(v.frame - s.frame) <= 900 or (s.frame - 100 <= v.frame and v.frame < s.frame + 2000)))""")
def rim_visits_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    visits = obs.where("kind = 'view'").select(F.col("event_id").alias("visit"), F.col("track").alias("segment"), F.col("frame").alias("peak"))
    shots = obs.where("kind = 'purchase'").select(F.col("track").alias("segment"), F.col("frame").alias("anchor"), (F.col("frame") - 100).alias("start"), (F.col("frame") + 2000).alias("end"))
    return V.uncovered_visits(visits, shots, 600.0)


@query(f"""with {OBSERVATIONS}, ev as (select track as segment, event_id, frame as anchor, frame - 40 as start, frame + 60 as "end" from obs where kind = 'purchase'), c as (select track as segment, frame - 200 as c_start, frame - 200 + event_id % 300 as c_end from obs where kind = 'view'),
b as (select ev.event_id, arg_max(c_start, c_end * 1000000.0 + c_start) as c_start from ev join c on ev.segment = c.segment and c_start <= anchor and least(c_end, anchor + 1) - c_start >= 6 group by ev.event_id)
select ev.event_id, greatest(least(coalesce(c_start, start), start) - 15, 0) as clip_start, "end" + 45 as clip_end from ev left join b using (event_id)""")
def clip_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    events = obs.where("kind = 'purchase'").select(F.col("track").alias("segment"), "event_id", F.col("frame").alias("anchor"), (F.col("frame") - 40).alias("start"), (F.col("frame") + 60).alias("end"))
    controls = obs.where("kind = 'view'").select(F.col("track").alias("segment"), (F.col("frame") - 200).alias("start"), (F.col("frame") - 200 + F.col("event_id") % 300).alias("end"))
    return V.clip_spans(events, controls, FPS).select("event_id", "clip_start", "clip_end")


@query(f"with {LEDGER} select event_id, type from led where type <> 'pass' and status = 'confirmed' and (type <> 'shot' or coalesce(outcome = 'made', false))")
def eligible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).withColumns({"outcome_value": F.col("outcome.value"), "outcome_status": F.col("outcome.status")})
    return rows.where(V.eligible()).select("event_id", "type")


@query(f"with {LEDGER} (select event_id from led where status = 'confirmed' except select event_id from led where type = 'pass') union (select event_id from led where status = 'uncertain' and type = 'pass')")
def selected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    chosen = rows.where("status = 'confirmed'").select("event_id").subtract(rows.where("type = 'pass'").select("event_id"))
    return chosen.union(rows.where("status = 'uncertain' and type = 'pass'").select("event_id")).distinct()


_TRUTH = {"buy": ("purchase", "click"), "look": ("view",)}
_EVAL = f"{OBSERVATIONS}, tr as (select event_id as truth_id, case when kind = 'error' then 'buy' else 'look' end as category, frame as start, frame + 5 - event_id % 9 as \"end\", track from obs where kind in ('error', 'signup', 'search', 'scroll')), ex(category, type, rank) as (values ('buy', 'purchase', 0), ('buy', 'click', 1), ('look', 'view', 0))"


def _evaluation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    obs = observations(spark, sf_dir)
    truth = obs.where("kind in ('error', 'signup', 'search', 'scroll')").select(F.col("event_id").alias("truth_id"), F.when(F.col("kind") == "error", "buy").otherwise("look").alias("category"), F.col("frame").alias("start"), (F.col("frame") + 5 - F.col("event_id") % 9).alias("end"), F.array(F.col("track").cast("string")).alias("ids"))
    found = obs.where("kind in ('purchase', 'click', 'view')").select(F.col("event_id").alias("det_id"), F.col("kind").alias("type"), "frame", F.col("track").cast("string").alias("actor"))
    return truth, found, E.expected_types(spark, _TRUTH)


@query(f"""with {_EVAL}, r as (select tr.truth_id, o.event_id as det_id, abs(o.frame - tr.start) as off, row_number() over (partition by tr.truth_id order by ex.rank, abs(o.frame - tr.start), o.event_id) as n
  from tr join ex using (category) join obs o on o.kind = ex.type and o.track = tr.track and abs(o.frame - tr.start) <= 500)
select tr.truth_id, tr.category, r.det_id, r.off from tr left join r on r.truth_id = tr.truth_id and r.n = 1""")
def annotation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found, expected = _evaluation(spark, sf_dir)
    return E.match_within(truth, found, expected, 500).select("truth_id", "category", "det_id", "off")


@query(f"with {_EVAL} select o.event_id as det_id from obs o where o.kind in ('purchase', 'click', 'view') and not exists (select 1 from tr join ex using (category) where ex.type = o.kind and abs(tr.start - o.frame) <= 3)")
def detection_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found, expected = _evaluation(spark, sf_dir)
    return E.extras(found, truth, expected, 3).select("det_id")


@query("select o_orderkey, ((o_orderkey % 24 * 60 + o_custkey % 60) * 60 + o_orderkey % 60) * 30 + o_custkey % 30 as frame, o_orderkey % 24 * 3600 + o_custkey % 60 * 60 + (o_orderkey % 60) + 0.5 as seconds, 'v' || o_custkey || ',' || lpad(cast(o_orderkey % 1000 as varchar), 4, '0') as image from orders")
def time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    code = F.format_string("%02d:%02d:%02d:%02d", k % 24, c % 60, k % 60, c % 30)
    stamp = F.format_string("%02d:%02d:%02d.5", k % 24, c % 60, k % 60)
    return table(spark, sf_dir, "orders").select(k, X.timecode_frame(code).alias("frame"), X.timestamp_seconds(stamp).alias("seconds"), X.image_key(F.concat(F.lit("v"), c.cast("string")), k % 1000).alias("image"))


@query("select conv_id, turn, array_to_string(list_filter([case when contains(text, 'tion') then 'made' end, case when contains(text, 'ing') or contains(text, 'ung') then 'block' end], lambda x: x is not null), ',') as kinds from conversations")
def text_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.categories(F.coalesce("text", F.lit("")), {"made": ["tion"], "block": ["ing", "ung"]}), ",").alias("kinds"))


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 200) / 10.0::double as x, (l_suppkey % 100) / 10.0::double as y from lineitem),
d as (select *, case when x > 2 and x < 10 and y > 1 and y < 6 then least(x - 2, 10 - x, y - 1, 6 - y) else -sqrt(greatest(2 - x, 0, x - 10) ** 2 + greatest(1 - y, 0, y - 6) ** 2) end as d from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when round(d, 6) >= 0.3 then 'inside_arc' when round(d, 6) <= -0.3 then 'outside_arc' else 'unknown' end as zone from d""")
def shot_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 200) / F.lit(10.0), (F.col("l_suppkey") % 100) / F.lit(10.0)
    d = F.round(X.polygon_distance(x, y, [(2, 1), (10, 1), (10, 6), (2, 6)]), 6)
    zone = F.when(d >= 0.3, "inside_arc").when(d <= -0.3, "outside_arc").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", zone.alias("zone"))


@query(f"""with {OBSERVATIONS}, r as (select *, lag(frame) over w as f0, lag(value) over w as v0 from obs window w as (partition by track order by event_id))
select event_id, round(sqrt((value - v0) ** 2 + (event_id % 5 - lag_id % 5) ** 2) / ((frame - f0) / 30.0), 6) as speed from (select *, lag(event_id) over (partition by track order by event_id) as lag_id from r) where frame > f0""")
def track_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).withColumn("y", (F.col("event_id") % 5).cast("double"))
    w = Window.partitionBy("track").orderBy("event_id")
    moved = obs.withColumns({"f0": F.lag("frame").over(w), "v0": F.lag("value").over(w), "y0": F.lag("y").over(w)}).where("frame > f0")
    return moved.select("event_id", F.round(X.distance((F.col("value"), F.col("v0")), (F.col("y"), F.col("y0"))) / ((F.col("frame") - F.col("f0")) / FPS), 6).alias("speed"))


@query("""with l as (select vec_id, label, cast(embedding as double[]) as v from embeddings), u as (select label, i, avg(v[i] / sqrt(list_sum(list_transform(v, lambda a: a * a)))) as m from l, unnest(range(1, 65)) t(i) group by label, i),
s as (select label, sqrt(sum(m * m)) as n from u group by label) select u.label, cast(u.i - 1 as integer) as i, round(u.m / s.n, 9) as u from u join s using (label)""")
def identity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = T.mean_unit_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return unit.select("label", F.posexplode("unit").alias("i", "u")).withColumn("u", F.round("u", 9))


@query(f"with {OBSERVATIONS} select track, kind, median(value) as x, count(*) as n from obs group by track, kind")
def cluster_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("track", "kind", F.col("value").alias("x"), F.col("value").alias("y"))
    return P.clusters(rows, ["track", "kind"], 1e9).select("track", "kind", "x", "n")


@query()
def smoothed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.majority(observations(spark, sf_dir), ["track"], "event_id", "kind", 2, 3).select("event_id", "kind")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).groupBy(F.col("track").alias("segment"), F.floor(F.col("frame") / 300).alias("frame")).agg(F.min("value").alias("v"))
    return obs.select("segment", "frame", (F.col("v") / 100).alias("x"), (F.col("frame") % 7 / 10).alias("y"), (1 + F.col("v") / 200).alias("z"), F.lit(3).cast("long").alias("views"))


@query()
def trajectory_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.flag_outliers(_positions(spark, sf_dir), FPS)


@query()
def smoothed_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.smooth(_positions(spark, sf_dir), FPS)


@query()
def filtered_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _positions(spark, sf_dir).withColumnRenamed("segment", "track")
    return stateful.run_batch(rows, ["track"], stateful.BallFilter)


@query()
def followed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    boxes = d.select((F.floor(F.col("image") / 500)).alias("segment"), F.col("image").alias("frame"), "det", ((F.col("box.x1") + F.col("box.x2")) / 2).alias("x"), ((F.col("box.y1") + F.col("box.y2")) / 2).alias("y"))
    return P.follow_centres(boxes, gate=8.0, look_back=3)


@query("select vec_id as query, vec_id as id, 1.0::double as similarity from embeddings where vec_id % 20 = 0")
def nearest_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return R.retrieve(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 1).select("query", "id", F.round("similarity", 9).alias("similarity"))
