"""All queries of the engine's own operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import intervals as I
from framelake.operators import matching as M
from framelake.operators import ranking as R
from framelake.operators import sequences as S
from framelake.operators import statistics as T

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "box_score"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- box score and counts ----

_COUNTS = {
    "shot_attempts_detected": "type = 'shot'",
    "made": "type = 'shot' and outcome = 'made'",
    "missed": "type = 'shot' and outcome = 'missed'",
    "outcome_unknown": "type = 'shot' and coalesce(outcome, '') not in ('made', 'missed')",
    "made_inside_arc": "type = 'shot' and outcome = 'made' and zone = 'inside_arc'",
    "made_outside_arc": "type = 'shot' and outcome = 'made' and zone = 'outside_arc'",
    "zone_unknown": "type = 'shot' and outcome = 'made' and zone is null",
    "rebounds_total": "type = 'rebound'",
    "rebounds_offensive": "type = 'rebound' and side = 'offensive'",
    "rebounds_defensive": "type = 'rebound' and side = 'defensive'",
    "rebounds_team_unknown": "type = 'rebound' and side is null",
    "steals": "type = 'steal'",
    "blocks": "type = 'block'",
    "successful_drives": "type = 'successful_drive'",
    "assist_chains": "type = 'assist_chain'",
    "passes": "type = 'pass' and role = 'passer'",
    "receptions": "type = 'pass' and role = 'receiver'",
}


@query(f"""with {V.LEDGER}, s as (
  select case when grouping(player) = 1 then 'all_players' else player end as player, {", ".join(f"count(*) filter ({c}) as {m}" for m, c in _COUNTS.items())}
  from (select *, case when sure and actor <> 'p8' then actor else 'unassigned' end as player from rol where status = 'confirmed') group by grouping sets ((player), ()))
select *, round(made / nullif(made + missed, 0), 4) as resolved_fg_pct, round((made + missed) / nullif(shot_attempts_detected, 0), 4) as outcome_coverage from s""")
def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = spark.range(8).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("player_id"))
    return T.box_score(V.ledger(spark, sf_dir), players)


@query("select cast(null as varchar) as metric, cast(null as bigint) as parts, cast(null as bigint) as total where false")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conserved(box_score(spark, sf_dir))


@query(f"with {V.LEDGER} select player, type, count(*) as n from (select 'all_players' as player, type from led where status = 'uncertain' union all select actor, type from rol where status = 'uncertain') group by player, type")
def uncertain_by_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.uncertain_counts(V.ledger(spark, sf_dir)).select("player", F.explode("uncertain").alias("type", "n"))


@query(f"with {V.LEDGER} select type, status, count(*) as n from led group by type, status")
def type_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reject_duplicates(V.ledger(spark, sf_dir), "event_id").groupBy("type", "status").agg(F.count("*").alias("n"))


@query(f"""with {V.LEDGER}, c as (select type, sum(case when status = 'confirmed' then 1 else 0 end) as tp, count(*) as predicted, count(*) + 5 as slots from led group by type)
select type, cast(tp as bigint) as tp, predicted, slots, predicted - tp as fp, slots - tp as fn, tp / nullif(predicted, 0) as precision, tp / nullif(slots, 0) as recall,
  2 * (tp / predicted) * (tp / slots) / nullif(tp / predicted + tp / slots, 0) as f1 from c""")
def retrieval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = V.ledger(spark, sf_dir).groupBy("type").agg(F.count_if(F.col("status") == "confirmed").alias("tp"), F.count("*").alias("predicted"), (F.count("*") + 5).alias("slots"))
    return T.retrieval_figures(counts, ["type"])


@query(f"""with {V.OBSERVATIONS}, a as (select kind, value as x, value * (event_id % 7) as y, frame // 500 as part from obs),
m as (select *, median(x) over w as mx, median(y) over w as my, count(*) over w as n from a window w as (partition by kind, part)),
d as (select *, sqrt((x - mx) ** 2 + (y - my) ** 2) as d from m), e as (select *, median(d) over (partition by kind, part) as md from d),
f as (select *, median(abs(d - md)) over (partition by kind, part) as mad from e),
g as (select *, n < 3 or d <= greatest(0.35, md + 2.5 * greatest(mad, 0.05)) as ok from f), h as (select *, count(*) filter (ok) over (partition by kind, part) as n_ok from g)
select kind, part, median(x) as x, median(y) as y, count(*) as used from h where ok or n_ok < 2 group by kind, part""")
def robust_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    return T.robust_mean(obs.select("kind", F.col("value").alias("x"), (F.col("value") * (F.col("event_id") % 7)).alias("y"), F.floor(F.col("frame") / 500).alias("part")), ["kind", "part"], "x", "y")


@query(f"""with {V.OBSERVATIONS}, t as (select track % 3 as "group", (track // 3) % 6 as a, event_id % 6 as b from obs),
sp as (select i, j from range(1, 6) x(i), range(1, 6) y(j) where i < j),
s as (select t."group", [0, i, j] as one, sum(case when list_contains([0, i, j], a) = list_contains([0, i, j], b) then 1 else -1 end) as score, count(*) as total from t, sp where a <> b group by t."group", i, j),
r as (select *, row_number() over w as n, lead(score) over w as second from s window w as (partition by "group" order by score desc, one))
select "group", score, second, total, case when total >= 18 and score >= 0.15 * total and score - second >= greatest(6, 0.15 * total) then array_to_string(one, ',') end as team_1 from r where n = 1""")
def team_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.observations(spark, sf_dir).select((F.col("track") % 3).alias("group"), (F.floor(F.col("track") / 3) % 6).alias("a"), (F.col("event_id") % 6).alias("b"))
    return T.split_into_teams(t).select("group", "score", "second", "total", F.array_join("team_1", ",").alias("team_1"))


# ---- intervals ----


@query(f"""with {V.OBSERVATIONS}, a as (select *, case when frame - lag(frame) over (partition by track order by frame, event_id) <= 240 then 0 else 1 end as new from obs),
b as (select *, sum(new) over (partition by track order by frame, event_id rows unbounded preceding) as island from a)
select track, cast(island as bigint) as island, min(frame) as start, max(frame) as "end", count(*) as n from b group by track, island having count(*) >= 2""")
def visit_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.islands(V.observations(spark, sf_dir), ["track"], "frame", 240, ties=["event_id"])
    return rows.groupBy("track", "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count("*").alias("n")).where("n >= 2")


_SPANS = f"{V.OBSERVATIONS}, sp as (select event_id, track, kind, frame - 600 as start, frame + 10 + event_id % 900 as \"end\" from obs)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    return obs.select("event_id", "track", "kind", (F.col("frame") - 600).alias("start"), (F.col("frame") + 10 + F.col("event_id") % 900).alias("end"))


_MERGED = f"""{_SPANS}, a as (select *, case when start <= max("end") over (partition by track order by start, "end", event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from sp),
b as (select *, sum(new) over (partition by track order by start, "end", event_id rows unbounded preceding) as part from a)"""


@query(f'with {_MERGED} select track, min(start) as start, max("end") as "end", count(*) as n, array_to_string(list(event_id order by event_id), \',\') as event_ids from b group by track, part')
def merged_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge_spans(_spans(spark, sf_dir), ["track"], collect=["event_id"]).withColumn("event_ids", F.array_join(F.col("event_ids").cast("array<string>"), ","))


@query(f'with {_MERGED}, m as (select track, min(start) as start, max("end") as "end" from b group by track, part) select track, cast(sum("end" - start) as bigint) as covered, count(*) as pieces from m group by track')
def clip_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.covered(_spans(spark, sf_dir), ["track"])


@query(f"""with {V.OBSERVATIONS}, a as (select *, case when kind = lag(kind) over w then 0 else 1 end as new from obs window w as (partition by track order by event_id)),
b as (select *, sum(new) over (partition by track order by event_id rows unbounded preceding) as run from a)
select track, cast(run as bigint) as run, kind, min(event_id) as start, max(event_id) + 1 as "end", count(*) as n from b group by track, run, kind""")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.run_lengths(V.observations(spark, sf_dir), ["track"], "event_id", ["kind"], step=None)


@query(f"""with recursive {V.OBSERVATIONS}, s as (select distinct track, cast(frame as double) as f from obs), o as (select *, row_number() over (partition by track order by f) as i from s),
r(track, i, f, lead, part) as (select track, i, f, f, 1 from o where i = 1 union all
  select o.track, o.i, o.f, case when o.f - r.lead > 600 then o.f else r.lead end, case when o.f - r.lead > 600 then r.part + 1 else r.part end from r join o on o.track = r.track and o.i = r.i + 1)
select track, part, min(f) as start, max(f) as "end", count(*) as n from r group by track, part""")
def positive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.anchored_groups(V.observations(spark, sf_dir).select("track", "frame").distinct(), ["track"], "frame", 600)


@query(f'with {_SPANS} select o.event_id, sp.event_id as span_id, sp.kind from obs o join sp on o.track = sp.track and o.frame >= sp.start and o.frame < sp."end"')
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = V.observations(spark, sf_dir).select("event_id", "track", "frame")
    return I.point_in_span(points, _spans(spark, sf_dir).withColumnRenamed("event_id", "span_id"), ["track"], "frame", 512).select("event_id", "span_id", "kind")


@query(f'with {_SPANS}, f as (select event_id, unnest(range("end" - 5 - event_id % 11, "end")) as frame from sp) select event_id, frame from f')
def action_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.expand(_spans(spark, sf_dir).withColumn("start", F.col("end") - 5 - F.col("event_id") % 11)).select("event_id", "frame")


@query(f"""with {V.OBSERVATIONS}, d as (select distinct track, frame from obs), g as (select track, lag(frame) over (partition by track order by frame) + 1 as start, frame as "end" from d)
select track, start, "end", "end" - start as length, "end" - start > 240 as too_long from g where start < "end" """)
def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.gaps(V.observations(spark, sf_dir).select("track", "frame").distinct(), ["track"], "frame", 240)


@query(f"""with {V.OBSERVATIONS}, sp as (select kind, frame - 1 as start, frame + 3 as "end" from obs), m as (select min(frame) as lo, max(frame) as hi from obs), f as (select unnest(range(lo, hi + 1)) as frame from m),
k as (select frame, bool_or(sp.kind = 'error') as dead, bool_or(sp.kind = 'purchase') as flight, bool_or(sp.kind = 'click') as held from f left join sp on f.frame >= sp.start and f.frame < sp."end" group by frame),
t as (select frame // 1440 as day, frame, case when dead then 'dead' when flight then 'flight' when held then 'held' else 'unknown' end as state from k),
a as (select *, case when state = lag(state) over (partition by day order by frame) then 0 else 1 end as new from t), b as (select *, sum(new) over (partition by day order by frame rows unbounded preceding) as run from a)
select day, state, min(frame) as start, max(frame) + 1 as "end" from b group by day, state, run""")
def possession_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    days = obs.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / 1440), F.floor(F.col("hi") / 1440))).alias("day"))
    frames = days.select("day", F.explode(F.sequence(F.greatest("lo", F.col("day") * 1440), F.least("hi", F.col("day") * 1440 + 1439))).alias("frame"))
    spans = obs.select("kind", F.explode(F.sequence(F.floor((F.col("frame") - 1) / 1440), F.floor((F.col("frame") + 2) / 1440))).alias("day"), (F.col("frame") - 1).alias("start"), (F.col("frame") + 3).alias("end"))
    seen = I.point_in_span(frames, spans, ["day"], "frame", 64).groupBy("day", "frame").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("error", "purchase", "click")])
    layered = I.timeline(frames.join(seen, ["day", "frame"], "left"), [("dead", F.col("error")), ("flight", F.col("purchase")), ("held", F.col("click"))])
    return I.run_lengths(layered, ["day"], "frame", ["state"]).select("day", "state", "start", "end")


# ---- joins in time ----


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = V.observations(spark, sf_dir)
    left = obs.where("kind = 'purchase'").select("track", "event_id", F.col("frame").alias("at"))
    right = obs.where("kind = 'view'").select("track", F.col("event_id").alias("other"), F.col("frame").alias("seen"))
    return left, right


_TWO = f"{V.OBSERVATIONS}, l as (select track, event_id, frame as at from obs where kind = 'purchase'), r as (select track, event_id as other, frame as seen from obs where kind = 'view')"


@query(f"with {_TWO}, m as (select l.event_id, r.other, r.seen, row_number() over (partition by l.event_id order by l.at - r.seen, r.other) as n from l join r on l.track = r.track and r.seen between l.at - 3000 and l.at) select l.event_id, m.other, m.seen from l left join m on l.event_id = m.event_id and m.n = 1")
def as_of_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.as_of(*_two(spark, sf_dir), ["track"], "event_id", "at", "seen", 3000, prefer=["other"]).select("event_id", "match.other", "match.seen")


@query(f"with {_TWO}, m as (select l.event_id, r.other, r.seen, row_number() over (partition by l.event_id order by r.seen - l.at, r.other) as n from l join r on l.track = r.track and r.seen between l.at and l.at + 3000) select l.event_id, m.other, m.seen from l left join m on l.event_id = m.event_id and m.n = 1")
def as_of_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.as_of(*_two(spark, sf_dir), ["track"], "event_id", "at", "seen", 3000, "forward", prefer=["other"]).select("event_id", "match.other", "match.seen")


@query(f"with {_TWO}, m as (select l.event_id, r.other, row_number() over (partition by l.event_id order by abs(l.at - r.seen), r.seen, r.other) as n from l join r on l.track = r.track and abs(r.seen - l.at) <= 1000) select l.event_id, m.other from l left join m on l.event_id = m.event_id and m.n = 1")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.as_of(*_two(spark, sf_dir), ["track"], "event_id", "at", "seen", 1000, "nearest", prefer=["other"]).select("event_id", "match.other")


@query(f"with {_TWO} select l.event_id, l.at from l where not exists (select 1 from r where r.track = l.track and abs(r.seen - l.at) <= 1000)")
def unmatched_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.without(*_two(spark, sf_dir), ["track"], "event_id", "at", "seen", -1000, 1000).select("event_id", "at")


@query(f"with {_TWO}, m as (select l.event_id, r.other, abs(r.seen - l.at) as off, row_number() over (partition by l.event_id order by abs(r.seen - l.at), r.other) as n from l join r on l.track = r.track and abs(r.seen - l.at) <= 5000) select event_id, other, off, n as rank, case when off <= 500 then 'late' else 'far' end as reason from m where n <= 3")
def mismatch_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _two(spark, sf_dir)
    pairs = M.within(left, right, ["track"], "at", "seen", -5000, 5000).withColumn("off", F.abs(F.col("seen") - F.col("at")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy("off", "other"))).where("rank <= 3")
    return ranked.select("event_id", "other", "off", "rank", F.when(F.col("off") <= 500, "late").otherwise("far").alias("reason"))


@query(f"with {V.OBSERVATIONS}, p as (select track, event_id, kind, frame, lead(event_id) over w as next_event_id, lead(kind) over w as next_kind, lead(frame) over w as next_frame from obs window w as (partition by track order by event_id)) select track, event_id, next_event_id, kind, next_kind from p where kind <> next_kind and next_frame - frame <= 2000")
def control_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.adjacent(V.observations(spark, sf_dir), ["track"], "event_id", ["event_id", "kind", "frame"])
    return pairs.where("kind <> next_kind and next_frame - frame <= 2000").select("track", "event_id", "next_event_id", "kind", "next_kind")


@query()
def slot_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    events = obs.where("kind = 'purchase'").select("track", F.col("event_id").alias("event"), F.col("frame").alias("at"))
    slots = obs.where("kind = 'view'").select("track", F.col("event_id").alias("slot"), (F.col("frame") - 900).alias("start"), (F.col("frame") + 900).alias("end"))
    return M.match_slots(events, slots, "track", 1800.0)


@query()
def track_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    part = F.floor(F.col("frame") / 2000).alias("part")
    a = obs.where("kind = 'view'").select("track", part, F.col("event_id").alias("row"), F.col("value").alias("v"), F.col("frame").alias("f"))
    b = obs.where("kind = 'click'").select("track", part, F.col("event_id").alias("col"), F.col("value").alias("w"), F.col("frame").alias("g"))
    pairs = a.join(b, ["track", "part"]).withColumn("cost", F.abs(F.col("v") - F.col("w")) + F.abs(F.col("f") - F.col("g")) / 100).where("cost < 60")
    return M.assign(pairs, ["track", "part"])


@query(f"""with {V.OBSERVATIONS}, c as (select a.event_id as "row", b.event_id as col, 1 - abs(a.value - b.value) / 100 as score from obs a join obs b on a.track = b.track and a.kind = 'purchase' and b.kind = 'click'),
r as (select *, row_number() over w as n, lead(score) over w as second from c window w as (partition by "row" order by score desc, col))
select "row", col, score from r where n = 1 and score >= 0.94 and score - coalesce(second, -1) >= 0.002""")
def identity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    a = obs.where("kind = 'purchase'").select("track", F.col("event_id").alias("row"), F.col("value").alias("v"))
    b = obs.where("kind = 'click'").select("track", F.col("event_id").alias("col"), F.col("value").alias("w"))
    pairs = a.join(b, "track").withColumn("score", 1 - F.abs(F.col("v") - F.col("w")) / 100)
    return M.mutual_margin(pairs, ["track"], 0.94, 0.002).select("row", "col", "score")


# ---- sequences ----


@query(f"""with {V.OBSERVATIONS}, a as (select event_id, track, value, count(*) over (partition by track) as n, count(value) over w as c, median(value) over w as m from obs window w as (partition by track order by event_id rows between 6 preceding and 6 following))
select event_id, case when n >= 13 and c >= 3 then m else value end as value from a""")
def median_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.median_smooth(V.observations(spark, sf_dir), ["track"], "event_id", ["value"]).select("event_id", "value")


@query(f"""with {V.OBSERVATIONS}, a as (select event_id, value, count(*) over (partition by track) as n, avg(value) over (partition by track order by event_id rows between 2 preceding and 2 following) as m from obs)
select event_id, round(case when n >= 5 then m else value end, 6) as value from a""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moving_average(V.observations(spark, sf_dir), ["track"], "event_id", ["value"], 5).select("event_id", F.round("value", 6).alias("value"))


def _gauss(k: int) -> str:
    return f"exp({-k * k / 2.0})"


@query(f"""with {V.OBSERVATIONS}, a as (select event_id, {", ".join(f"lag(value, {-k}) over w as v{k + 3}" for k in range(-3, 4))} from obs window w as (partition by track order by event_id))
select event_id, round(({" + ".join(f"coalesce(v{k + 3} * {_gauss(k)}, 0)" for k in range(-3, 4))}) / ({" + ".join(f"case when v{k + 3} is not null then {_gauss(k)} else 0 end" for k in range(-3, 4))}), 6) as value from a""")
def gaussian_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gaussian_smooth(V.observations(spark, sf_dir), ["track"], "event_id", ["value"], 1.0).select("event_id", F.round("value", 6).alias("value"))


@query(f"""with {V.OBSERVATIONS} select event_id, median(value) over (partition by track order by frame range between 2000 preceding and 1 preceding) as base,
  max(value) over (partition by track order by frame range between 1000 preceding and 1 preceding) - value as approach from obs""")
def trailing_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = V.observations(spark, sf_dir)
    return obs.select("event_id", S.trailing(obs, ["track"], "frame", "value", 2000, "median").alias("base"), (S.trailing(obs, ["track"], "frame", "value", 1000, "max") - F.col("value")).alias("approach"))


@query(f"""with {V.OBSERVATIONS}, a as (select event_id, track, frame, value, lag(value) over w as v0, lag(frame) over w as t0 from obs window w as (partition by track order by event_id))
select event_id, round(t0 + (frame - t0) * ((50 - v0) / (value - v0)), 6) as crossing from a where v0 <= 50 and value > 50 and frame - t0 <= 2000""")
def level_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.crossings(V.observations(spark, sf_dir), ["track"], "event_id", "frame", "value", 50.0, 2000)
    return found.select("event_id", F.round("crossing", 6).alias("crossing"))


@query(f"""with {V.OBSERVATIONS}, a as (select event_id, avg(value) over w as mean, median(value) over w as med from obs window w as (partition by kind order by event_id rows between 19 preceding and current row))
select event_id, round(mean, 6) as mean, med from a""")
def running_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.last_k(["kind"], "event_id", 20)
    return V.observations(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.percentile("value", 0.5).over(w).alias("med"))


@query('with s as (select c_custkey as track, 0 as start, cast(20 + c_custkey % 90 as bigint) as "end" from customer) select track, w as window_start, w + 32 as window_end from s, unnest(range(start, "end" - 31, 14)) t(w) where "end" - start >= 32')
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.lit(0).cast("long").alias("start"), (20 + F.col("c_custkey") % 90).alias("end"))
    return S.sliding_windows(spans, 32, 14).select("track", "window_start", "window_end")


@query("""select c_custkey as track, i, cast(floor(c_custkey % 50 + i * ((c_custkey % 90 + 9) / 7.0::double)) as bigint) as frame from customer, unnest(range(0, 8)) t(i)""")
def uniform_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, size = F.col("c_custkey") % 50, F.col("c_custkey") % 90 + 9
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.posexplode(S.uniform_sample(start, start + size, 8)).alias("i", "frame"))


@query("""select c_custkey as track, n - 1 as i, greatest(0, least(60, c_custkey % 70 - 8 + (n - 1) * 2)) as frame from customer, unnest(range(1, 9)) t(n)""")
def sequence_around_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = S.around(F.col("c_custkey") % 70, 8, 2, F.lit(0).cast("long"), F.lit(60).cast("long"))
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track"), F.posexplode(frames).alias("i", "frame"))


# ---- ranking and detection quality ----

_PR = """s as (select l_returnflag as label, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey as tie, l_extendedprice as score, case when l_linestatus = 'F' then 1 else 0 end as hit from lineitem),
n as (select label, sum(hit) as n_positive from s group by label),
c as (select s.*, n_positive, sum(hit) over w as tp, count(*) over w as k from s join n using (label) window w as (partition by label order by score desc, tie rows unbounded preceding)),
d as (select *, tp / k as precision, case when n_positive > 0 then tp / n_positive end as recall from c)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("tie"), F.col("l_extendedprice").alias("score"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("hit"))
    return R.precision_recall(rows, ["label"], rows.groupBy("label").agg(F.sum("hit").alias("n_positive")), "tie")


@query(f"with {_PR} select label, tie, precision, recall from d")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("label", "tie", "precision", "recall")


_AP = f"""{_PR}, e as (select *, max(precision) over (partition by label order by score desc, tie rows between current row and unbounded following) * (recall - coalesce(lag(recall) over (partition by label order by score desc, tie), 0)) as area from d),
ap as (select label, sum(area) as ap from e group by label)"""


@query(f"with {_AP} select label, round(ap, 9) as ap from ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_precision(_curve(spark, sf_dir), ["label"], "tie").select("label", F.round("ap", 9).alias("ap"))


@query(f"with {_AP} select round(avg(ap), 9) as map, count(ap) as classes from ap")
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_average_precision(R.average_precision(_curve(spark, sf_dir), ["label"], "tie")).select(F.round("map", 9).alias("map"), "classes")


_RANKS = f"{V.PREDICTIONS}, r as (select *, row_number() over (partition by sample order by score desc, label) as rank from pred)"


@query(f"with {_RANKS}, t as (select * from r where label = truth) select {', '.join(f'cast(sum(case when rank <= {k} then 1 else 0 end) as bigint) as top{k}_correct, 100 * avg(case when rank <= {k} then 1.0::double else 0 end) as top{k}_accuracy, 100 - 100 * avg(case when rank <= {k} then 1.0::double else 0 end) as top{k}_error' for k in (1, 3))} from t")
def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topk(R.rank_of_truth(V.predictions(spark, sf_dir), "sample", "label", "truth"), (1, 3))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = V.predictions(spark, sf_dir)
    return pred.groupBy("sample", "truth").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("predicted"))


@query(f"with {_RANKS} select truth, label as predicted, count(*) as n, count(*) / sum(count(*)) over (partition by truth) as share from r where rank = 1 group by truth, label")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confusion(_best(spark, sf_dir), "truth", "predicted")


@query(f'with {_RANKS} select truth, {", ".join(f"count(*) filter (label = {k}) as " + chr(34) + str(k) + chr(34) for k in range(5))} from r where rank = 1 group by truth')
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.confusion_matrix(_best(spark, sf_dir), "truth", "predicted", range(5))


@query(f"with {_RANKS} select truth, count(*) as n, avg(case when truth = label then 1.0::double else 0 end) as accuracy from r where rank = 1 group by truth")
def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_accuracy(_best(spark, sf_dir), "truth", "predicted")


@query("select event_type as kind, count(*) as n, sqrt(sum(count(*)) over () / (count(*) over () * count(*))) as weight from events group by event_type")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.class_weights(V.observations(spark, sf_dir), "kind")


@query("select event_type as kind, count(*) as n, 100 * count(*) / sum(count(*)) over () as percent from events group by event_type")
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distribution(V.observations(spark, sf_dir), "kind")


@query(f"with {V.PREDICTIONS} select sample // 10 as video, label, round(sum(score), 9) as score, count(*) as clips from pred group by sample // 10, label")
def clip_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ensemble(V.predictions(spark, sf_dir), "sample", "label", 10).withColumn("score", F.round("score", 9))


_KNN = """e as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
k as (select q.vec_id as query, m.vec_id as id, m.label, list_cosine_similarity(q.x, m.x) as similarity from e q join e m on q.vec_id % 20 = 0),
n as (select *, row_number() over (partition by query order by similarity desc, id) as rank from k)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return R.retrieve(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), 20)


@query(f"with {_KNN} select query, id, label, round(similarity, 9) as similarity, rank from n where rank <= 20")
def knn_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir).select("query", "id", "label", F.round("similarity", 9).alias("similarity"), "rank")


@query(f"with {_KNN} select query, label, round(sum(exp(similarity / 0.5)), 6) as vote from n where rank <= 20 group by query, label")
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weighted_vote(_neighbours(spark, sf_dir), "label", 0.5).withColumn("vote", F.round("vote", 6))


@query(f"""with {V.DETECTIONS}, g as (select image, det as gt, x1, y1, x2, y2 from det where label = 'A'), f as (select *, row_number() over (partition by image order by det) as place from det where label <> 'A'),
p as (select f.image, f.det, f.place, g.gt, {V.overlap_sql("f", "g")} as overlap from f left join g on f.image = g.image),
b as (select *, row_number() over (partition by image, det order by overlap desc, gt) as n from p),
m as (select *, gt is not null and overlap >= 0.5 as enough from b where n = 1),
h as (select *, row_number() over (partition by image, case when enough then gt end order by place) as claim from m)
select image, det, gt, round(overlap, 9) as overlap, case when enough and claim = 1 then 1 else 0 end as hit from h""")
def box_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = V.detections(spark, sf_dir)
    found = det.where("label <> 'A'").withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy("det")))
    truth = det.where("label = 'A'").select("image", F.col("det").alias("gt"), F.col("box").alias("gt_box"))
    return R.match_boxes(found.select("image", "det", "score", "place", "box"), truth, ["image"], 0.5).select("image", "det", "gt", F.round("overlap", 9).alias("overlap"), "hit")


@query(f"""with recursive {V.DETECTIONS}, d as (select *, row_number() over (partition by image order by score desc, det) as i from det),
r(image, i, kept) as (select image, 1, [det] from d where i = 1 union all
  select d.image, d.i, case when exists (select 1 from d k where k.image = d.image and list_contains(r.kept, k.det) and {V.overlap_sql("d", "k")} > 0.5) then r.kept else list_append(r.kept, d.det) end from r join d on d.image = r.image and d.i = r.i + 1),
l as (select image, kept, row_number() over (partition by image order by i desc) as n from r)
select image, unnest(kept) as det from l where n = 1""")
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suppress(V.detections(spark, sf_dir), ["image"], 0.5)


@query(f"with {V.DETECTIONS}, r as (select *, row_number() over (partition by image, label order by score desc, det) as rank from det) select image, label, det, rank from r where rank <= 2")
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("image", "label").orderBy(F.desc("score"), "det")
    return V.detections(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("image", "label", "det", "rank")


@query(f"""with recursive {V.OBSERVATIONS}, c as (select track, event_id as clip, 10 + event_id % 50 as length, row_number() over (partition by track order by value desc, 10 + event_id % 50, event_id) as i from obs),
r(track, i, budget, kept) as (select distinct track, cast(0 as bigint), cast(200 as bigint), cast([] as bigint[]) from c union all
  select c.track, c.i, case when c.length <= r.budget then r.budget - c.length else r.budget end, case when c.length <= r.budget then list_append(r.kept, c.clip) else r.kept end from r join c on c.track = r.track and c.i = r.i + 1),
l as (select track, kept, row_number() over (partition by track order by i desc) as n from r) select track, unnest(kept) as clip from l where n = 1""")
def highlight_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = V.observations(spark, sf_dir).select("track", F.col("event_id").alias("clip"), F.col("value").alias("score"), (10 + F.col("event_id") % 50).alias("length"))
    return T.greedy_budget(clips, ["track"], 200)
