"""Queries of evidence for steals, blocks, drives and acquisitions, of picture quality, and of broken checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import cameras as C
from framelake.operators import evidence as E
from framelake.operators import integrity as I
from framelake.operators import matching as M
from framelake.operators import statistics as T

from .detail import _SAMPLES, FPS, _orders, _samples, _spans
from .registry import query
from .views import DETECTIONS, LEDGER, detections, ledger


@query(f"""with {_SAMPLES}, g as (select *, frame - lag(frame) over (partition by segment, view order by frame) as gap from smp),
w as (select *, first_value(frame) over b as f0, first_value(x) over b as x0, first_value(y) over b as y0, last_value(frame) over a as f1, last_value(x) over a as x1, last_value(y) over a as y1,
  max(gap) over (partition by segment, view order by frame range between 4 preceding and 5 following) as hole from g
  window b as (partition by segment, view order by frame range between 5 preceding and current row), a as (partition by segment, view order by frame range between current row and 5 following)),
m as (select *, sqrt((x - x0) ** 2 + (y - y0) ** 2) as la, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) as lb, (x - x0) * (x1 - x) + (y - y0) * (y1 - y) as d from w where f0 < frame and frame < f1)
select segment, view, frame, round(d / (la * lb), 9) as cosine from m where la / (frame - f0) >= 1 and lb / (f1 - frame) >= 1 and hole <= 3 and d / (la * lb) <= 0.4""")
def ball_deflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = E.deflections(_samples(spark, sf_dir))
    return turns.select("segment", "view", "frame", F.round("cosine", 9).alias("cosine"))


def _player(n: Column) -> Column:
    return F.concat(F.lit("p"), (n % 9).cast("string"))


def _team(n: Column) -> Column:
    return F.when(n % 9 < 8, n % 2)


def _contacts(spark: SparkSession, sf_dir: str, shift: int) -> tuple[DataFrame, DataFrame]:
    """Touches (segment, frame, view, track, team) and turns (segment, frame, view) around the orders' frames."""
    c, k, at = F.col("c"), F.col("o_orderkey"), F.col("at")
    views = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    rows = _orders(spark, sf_dir).withColumn("view", F.explode(views))
    frame = at + shift + c % 7
    touches = rows.select("segment", frame.alias("frame"), "view", _player(c + 4).alias("track"), _team(c + 4).alias("team")).distinct()
    return touches, rows.where("o_orderkey % 5 < 3").select("segment", (frame + k % 3).alias("frame"), "view").distinct()


_CONTACTS = """orr as (select o_orderkey as k, o_custkey as c, o_orderkey % 4 as segment, o_orderkey % 5000 * 4 as at_ from orders),
orv as (select *, unnest(case k % 3 when 0 then ['a', 'b'] when 1 then ['a'] else ['b'] end) as view from orr),
tch as (select distinct segment, at_ + {shift} + c % 7 as frame, view, 'p' || ((c + 4) % 9) as track, case when (c + 4) % 9 < 8 then (c + 4) % 2 end as team from orv),
trn as (select distinct segment, at_ + {shift} + c % 7 + k % 3 as frame, view from orv where k % 5 < 3)"""


@query(f"""with {_CONTACTS.format(shift=9)},
prs as (select distinct segment, 'p' || (c % 9) as owner, 'p' || ((c + 4) % 9) as next_owner, at_ + 10 as "end", at_ + 10 + c % 5 as next_start, at_ + 10 + c % 5 + c % 12 as next_end,
  case when c % 9 < 8 then c % 2 end as team, case when (c + 4) % 9 < 8 then (c + 4) % 2 end as next_team from orr),
ner as (select distinct p.segment, owner, next_owner, "end", next_start, t.frame as f, t.view from prs p join tch t on t.segment = p.segment and t.track = next_owner and t.frame - next_start between -15 and 6),
frm as (select n.segment, owner, next_owner, "end", next_start, f, count(distinct n.view) as views, count(distinct case when abs(r.frame - f) <= 2 then n.view end) as turns, max(case when r.frame between f and f + 3 then true end) as prior
  from ner n left join trn r on r.segment = n.segment and r.view = n.view and r.frame between f - 2 and f + 3 group by all),
bst as (select * from frm qualify row_number() over (partition by segment, owner, next_owner, "end", next_start order by views desc, turns desc, f) = 1)
select p.segment, p.owner, p.next_owner, p."end", p.next_start, f as frame, views,
  concat_ws(',', case when team is null or next_team is null or team = next_team then 'TEAM_RELATION_UNKNOWN' end, case when coalesce(views, 0) < 2 then 'CONTACT_UNVERIFIED' end,
    case when coalesce(turns, 0) < 1 then 'DEFLECTION_UNVERIFIED' end, case when prior is null then 'NO_PRIOR_TOUCH' end, case when next_end - p.next_start < 8 then 'CONTROL_TOO_BRIEF' end) as reasons
from prs p left join bst b on b.segment = p.segment and b.owner = p.owner and b.next_owner = p.next_owner and b."end" = p."end" and b.next_start = p.next_start""")
def steal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches, turns = _contacts(spark, sf_dir, 9)
    c, at = F.col("c"), F.col("at")
    start = at + 10 + c % 5
    pairs = _orders(spark, sf_dir).select("segment", _player(c).alias("owner"), _player(c + 4).alias("next_owner"), (at + 10).alias("end"), start.alias("next_start"), (start + c % 12).alias("next_end"), _team(c).alias("team"), _team(c + 4).alias("next_team")).distinct()
    found = E.steals(pairs, touches, turns, FPS)
    return found.select("segment", "owner", "next_owner", "end", "next_start", "frame", "views", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with {_CONTACTS.format(shift=2)},
sht as (select segment, k as event_id, at_ as anchor, 'p' || (c % 9) as shooter, case when c % 9 < 8 then c % 2 end as team, case k % 4 when 0 then 'made' when 1 then 'missed' end as outcome from orr where c % 2 = 0),
one as (select * from tch qualify row_number() over (partition by segment, frame, view order by track, team nulls first) = 1),
hit as (select distinct t.segment, t.frame, t.view, t.track, t.team from one t join trn using (segment, frame, view)),
frm as (select s.segment, event_id, anchor, s.team, outcome, h.frame, track, h.team as t_team, count(distinct view) as views from sht s join hit h on h.segment = s.segment and h.frame - anchor between -8 and 23 and track <> shooter group by all),
bst as (select * from frm qualify row_number() over (partition by segment, event_id order by views desc, abs(frame - anchor), frame, track) = 1)
select segment, event_id, frame, views, case when outcome = 'made' then 'rejected' when views >= 2 and team <> t_team then 'confirmed' else 'uncertain' end as status from bst""")
def block_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches, turns = _contacts(spark, sf_dir, 2)
    c, k = F.col("c"), F.col("o_orderkey")
    shots = _orders(spark, sf_dir).where("c % 2 = 0").select("segment", k.alias("event_id"), F.col("at").alias("anchor"), _player(c).alias("shooter"), _team(c).alias("team"), F.when(k % 4 == 0, "made").when(k % 4 == 1, "missed").alias("outcome"))
    # One player a frame touches the ball, so that the best contact has no tie.
    one = touches.groupBy("segment", "frame", "view").agg(F.min(F.struct("track", "team")).alias("t")).select("segment", "frame", "view", "t.*")
    return E.blocks(shots, one, turns, FPS).select("segment", "event_id", "frame", "views", "status")


_GROUND = """grd as (select segment, f as frame, 'p' || p as track, ((f * (p + 2)) % 31) / 2 as x, ((f * (p + 5)) % 29) / 2 as y, case when p < 8 then p % 2 end as team
  from (select distinct segment, start + i as f from spn, range(0, 40) r(i) where start + i < "end") s, range(0, 9) q(p) where (f + p) % 4 <> 0)"""


@query(f"""with spn as (select distinct o_orderkey % 4 as segment, 'p' || (o_custkey % 9) as owner, o_orderkey % 5000 * 4 as start, o_orderkey % 5000 * 4 + 10 + o_custkey % 30 as "end" from orders), {_GROUND},
d as (select *, sqrt((x - 2) ** 2 + (y - 7) ** 2) as d from grd),
m as (select s.segment, s.owner, s.start, s."end", o.frame, o.d as od, o.team as ot, e.track as defender, e.d as dd, e.team as dt, sqrt((e.x - o.x) ** 2 + (e.y - o.y) ** 2) as apart
  from spn s join d o on o.segment = s.segment and o.track = s.owner and o.frame >= s.start and o.frame < s."end" join d e on e.segment = s.segment and e.frame = o.frame and e.track <> s.owner where s."end" - s.start >= 20),
a as (select segment, owner, start, "end", defender, frame as f0, od as d0 from m where ot <> dt and apart <= 2 and dd <= od qualify row_number() over (partition by segment, owner, start, "end", defender order by frame, od) = 1),
e as (select m.segment, m.owner, m.start, m."end", m.defender, f0, m.frame, d0 - od as gain from m join a using (segment, owner, start, "end", defender) where m.frame > f0 and d0 - od >= 0.9 and od < dd)
select segment, owner, start, "end", f0 as begin, defender, frame as finish, round(gain, 9) as advance from e qualify row_number() over (partition by segment, owner, start, "end" order by f0, defender, frame, gain) = 1""")
def drive_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).select("segment", "owner", "start", "end").distinct()
    frames = spans.where("start < end").select("segment", F.explode(F.sequence("start", F.col("end") - 1)).alias("frame")).distinct()
    f, p = F.col("frame"), F.col("p")
    rows = frames.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(8)))).where("(frame + p) % 4 <> 0")
    ground = rows.select("segment", "frame", _player(p).alias("track"), (f * (p + 2) % 31 / 2).alias("x"), (f * (p + 5) % 29 / 2).alias("y"), F.when(p < 8, p % 2).alias("team"))
    found = E.drives(spans, ground, (2.0, 7.0), FPS)
    return found.select("segment", "owner", "start", "end", "begin", "defender", "finish", F.round("advance", 9).alias("advance"))


@query(f"""with {_CONTACTS.format(shift=4)},
opt as (select segment, k - k % 3 as miss, 'p' || ((c + 4) % 9) as owner, at_ + c % 4 as start, min(at_ + c % 4 + 2 + c % 11) as "end" from orr group by all),
fst as (select * from opt qualify row_number() over (partition by segment, miss order by start, owner, "end") = 1),
v as (select f.segment, miss, count(distinct view) as views from fst f join tch t on t.segment = f.segment and t.track = owner and t.frame - start between 0 and 6 group by all)
select f.segment, f.miss, owner, start, "end", coalesce(views, 0) as views, "end" - start >= 8 or coalesce(views, 0) >= 2 as confirmed,
  case when "end" - start >= 8 then 'stable_control' when views >= 2 then 'brief_multi_view' else 'unverified' end as method from fst f left join v on v.segment = f.segment and v.miss = f.miss""")
def rebound_acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches, _ = _contacts(spark, sf_dir, 4)
    c, k, at = F.col("c"), F.col("o_orderkey"), F.col("at")
    options = _orders(spark, sf_dir).select("segment", (k - k % 3).alias("miss"), _player(c + 4).alias("owner"), (at + c % 4).alias("start"), (at + c % 4 + 2 + c % 11).alias("end"))
    # One end for each begin of an owner, so that the first option has no tie.
    options = options.groupBy("segment", "miss", "owner", "start").agg(F.min("end").alias("end"))
    return E.acquisitions(options, touches, FPS).withColumn("views", F.coalesce("views", F.lit(0)))


_BOXES = f"""{DETECTIONS}, box as (select 0 as segment, image as frame, 'v' as view, det as track, x1, y1, x2, y2, (det % 5) / 4 as joints from det)"""


@query(f"""with {_BOXES}, c as (select b.frame, b.track, sum(greatest(least(b.x2, o.x2) - greatest(b.x1, o.x1), 0) * greatest(least(b.y2, o.y2) - greatest(b.y1, o.y1), 0) / greatest((b.x2 - b.x1) * (b.y2 - b.y1), 1)) as covered
  from box b join box o on b.frame = o.frame and b.track <> o.track group by all),
m as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from box),
j as (select m.*, sqrt((n.cx - 2 * m.cx + p.cx) ** 2 + (n.cy - 2 * m.cy + p.cy) ** 2) / greatest(m.y2 - m.y1, 1) as jitter from m left join m p on p.track = m.track and p.frame = m.frame - 3 left join m n on n.track = m.track and n.frame = m.frame + 3)
select j.segment, j.frame, j.view, j.track, round(0.35 * (1 - least(coalesce(covered, 0), 1)) + 0.25 * least((y2 - y1) / (0.4 * 30), 1) + 0.2 * joints + 0.15 * coalesce(greatest(1 - 5 * jitter, 0), 0)
  + 0.05 * case when x1 >= 0 and y1 >= 0 and x2 <= 20 and y2 <= 30 then 1 else 0 end, 9) as quality from j left join c on c.frame = j.frame and c.track = j.track""")
def box_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    boxes = d.select(F.lit(0).alias("segment"), F.col("image").alias("frame"), F.lit("v").alias("view"), F.col("det").alias("track"), "box.*", (F.col("det") % 5 / 4).alias("joints"))
    return C.box_quality(boxes, 20.0, 30.0).withColumn("quality", F.round("quality", 9))


@query(f"""with {LEDGER}, s as (select coalesce(player, 'all_players') as player, count(*) filter (type = 'steal') as steals, count(*) filter (type = 'shot') as shot_attempts_detected
  from (select *, case when sure and actor <> 'p8' then actor else 'unassigned' end as player from rol where status = 'confirmed') group by grouping sets ((player), ())),
b as (select player, steals + case when player = 'p3' then 2 else 0 end as steals, shot_attempts_detected - case when player = 'all_players' then 1 else 0 end as shot_attempts_detected from s),
l as (select player, unnest(['steals', 'shot_attempts_detected']) as metric, unnest([steals, shot_attempts_detected]) as n from b)
select metric, cast(sum(n) filter (player <> 'all_players') as bigint) as parts, cast(sum(n) filter (player = 'all_players') as bigint) as total from l group by metric having sum(n) filter (player <> 'all_players') <> sum(n) filter (player = 'all_players')""")
def broken_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a box score of which one player's steals and the total of shots were changed."""
    players = spark.range(8).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("player_id"))
    score = T.box_score(ledger(spark, sf_dir), players)
    steals = F.col("steals") + F.when(F.col("player") == "p3", 2).otherwise(0)
    shots = F.col("shot_attempts_detected") - F.when(F.col("player") == "all_players", 1).otherwise(0)
    return T.conserved(score.withColumns({"steals": steals, "shot_attempts_detected": shots}))


@query(f"""with {LEDGER}, one as (select event_id from led where status = 'confirmed'), two as (select event_id from led where type <> 'pass'),
d as (select event_id, 'left' as side from (select event_id from one except select event_id from two) union all select event_id, 'right' from (select event_id from two except select event_id from one)),
m as (select event_id from (select event_id from led where status = 'uncertain') except select event_id from two)
select event_id, side from d union all select event_id, 'missing' from m""")
def plan_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that only one of two plans has, and uncertain ones that the second plan misses."""
    rows = ledger(spark, sf_dir).select("event_id", "status", "type")
    one, two = rows.where("status = 'confirmed'"), rows.where("type <> 'pass'")
    lost = I.missing(rows.where("status = 'uncertain'"), two, ["event_id"]).withColumn("side", F.lit("missing"))
    return I.unequal(one, two, ["event_id"]).union(lost)


@query(f"""with {_SAMPLES}, pl as (select distinct o_orderkey % 4 as segment, 'ab'[o_orderkey % 2 + 1] as view, o_orderkey % 5000 * 4 + 1 as frame, 'p' || (o_custkey % 9) as player, (o_custkey % 97)::double as px, (o_custkey % 89)::double as py from orders)
select segment, view, frame, player, round(sqrt((px - x) ** 2 + (py - y) ** 2), 9) as distance, row_number() over (partition by segment, view, frame order by sqrt((px - x) ** 2 + (py - y) ** 2), player) as rank
from pl join smp using (segment, view, frame) qualify rank <= 2""")
def nearest_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two players nearest to the ball in each picture that shows it."""
    c, k = F.col("c"), F.col("o_orderkey")
    people = _orders(spark, sf_dir).select("segment", F.when(k % 2 == 0, "a").otherwise("b").alias("view"), (F.col("at") + 1).alias("frame"), _player(c).alias("player"), (c % 97).cast("double").alias("px"), (c % 89).cast("double").alias("py")).distinct()
    balls = _samples(spark, sf_dir).withColumn("ball", F.concat_ws("-", "segment", "view", "frame"))
    away = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))
    near = M.nearest(balls, people, ["segment", "view", "frame"], "ball", away, "player", 2)
    return near.select("segment", "view", "frame", "player", F.round("distance", 9).alias("distance"), "rank")
