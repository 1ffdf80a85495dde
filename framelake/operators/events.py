"""From contacts to an event ledger: ball control, transfers, passages, links between events, possession.

Tables carry ``segment`` as their key; frames count within it. Seconds become frames by half-even rounding.
Everything is joins and windows, except ownership, whose state depends on all frames before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, matching


@dataclass(frozen=True)
class Rules:
    """Thresholds of the event rules; all are positive. Distances are shares of a person's height in the image."""

    ball_confidence: float = 0.16
    keypoint_confidence: float = 0.35
    hand_distance: float = 0.16
    control_seconds: float = 0.10
    control_gap_seconds: float = 0.30
    observation_gap_seconds: float = 0.10
    passage_seconds: float = 0.40
    fusion_seconds: float = 0.20
    visit_gap_seconds: float = 0.45
    flight_seconds: float = 3.0
    pre_seconds: float = 2.5
    post_seconds: float = 1.5

    def __post_init__(self) -> None:
        bad = [f.name for f in fields(self) if getattr(self, f.name) <= 0]
        if bad:
            raise ValueError(f"not positive: {', '.join(bad)}")


def overlay(primary: DataFrame, sidecar: DataFrame, least: float) -> DataFrame:
    """Balls by (segment, frame, view): the sidecar only fills views that the primary table lacks."""
    keys = ["segment", "frame", "view"]
    values = [c for c in primary.columns if c not in keys]
    other = sidecar.select(*keys, *[F.col(c).alias(f"s_{c}") for c in values], F.lit(True).alias("s_has"))
    own = primary.withColumn("p_has", F.lit(True))
    picked = own.join(other, keys, "full").select(*keys, *[F.when(F.col("p_has"), F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) for c in values])
    finite = ~F.isnan("x") & ~F.isnan("y") & F.col("x").isNotNull() & F.col("y").isNotNull()
    return picked.where(finite & (F.col("confidence") >= least))


def hand_distances(hands: DataFrame, balls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Median over views of the least wrist to ball distance, as a share of height, within the gate.

    ``hands`` has segment, frame, view, track, height, wrists (array of x, y, confidence); ``balls`` has
    segment, frame, view, x, y.
    """
    met = hands.join(balls, ["segment", "frame", "view"]).where("height > 0")
    good = F.filter("wrists", lambda w: (w["confidence"] >= rules.keypoint_confidence) & ~F.isnan(w["x"]) & ~F.isnan(w["y"]))
    near = F.array_min(F.transform(good, lambda w: F.sqrt(F.pow(w["x"] - F.col("x"), 2) + F.pow(w["y"] - F.col("y"), 2)))) / F.col("height")
    by_view = met.select("segment", "frame", "view", "track", near.alias("distance")).where("distance is not null")
    median = by_view.groupBy("segment", "frame", "track").agg(F.percentile("distance", 0.5).alias("distance"), F.count("*").alias("views"))
    return median.where(F.col("distance") < rules.hand_distance)


def frame_owners(distances: DataFrame, margin: float = 0.03) -> DataFrame:
    """The nearest track of each frame, if the second nearest is farther by more than ``margin``."""
    w = Window.partitionBy("segment", "frame").orderBy("distance", "track")
    ranked = distances.withColumns({"n_": F.row_number().over(w), "next_": F.lead("distance").over(w)})
    return ranked.where((F.col("n_") == 1) & (F.col("next_").isNull() | (F.col("next_") - F.col("distance") > margin))).select("segment", "frame", F.col("track").alias("owner"))


class Ownership:
    """Owner of the ball with hysteresis: the one rule that batch and stream share."""

    def __init__(self, least: int, longest: int, state: tuple | None = None) -> None:
        self.least, self.longest = least, longest
        self.owner, self.start, self.seen, self.candidate, self.count = state or (None, 0, 0, None, 0)

    def state(self) -> tuple:
        return self.owner, self.start, self.seen, self.candidate, self.count

    def step(self, frame: int, owner: str | None) -> Iterator[tuple[str, int, int]]:
        """Take the next frame; yields the spans (owner, start, end) that it ends."""
        if self.owner is not None and frame - self.seen > self.longest:
            yield self.close()
        if owner is not None and owner == self.owner:
            self.seen, self.candidate, self.count = frame, None, 0
            return
        if owner is None:
            self.candidate, self.count = None, 0
            return
        self.count = self.count + 1 if owner == self.candidate else 1
        self.candidate = owner
        if self.count >= self.least:
            if self.owner is not None:
                yield self.close()
            self.owner, self.start, self.seen = owner, frame - self.count + 1, frame
            self.candidate, self.count = None, 0

    def close(self) -> tuple[str, int, int]:
        span = (self.owner, self.start, self.seen + 1)
        self.owner = None
        return span


def control_frames(rules: Rules, fps: float) -> tuple[int, int]:
    """Frames that make an owner, and frames that an owner may be unseen."""
    return max(2, round(rules.control_seconds * fps)), round(rules.control_gap_seconds * fps)


def _spans(least: int, longest: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        machine, out = Ownership(least, longest), []
        for frame, owner in zip(rows["frame"].tolist(), rows["owner"].tolist(), strict=True):
            out += machine.step(frame, None if owner is None or owner != owner else owner)
        if machine.owner is not None:
            out.append(machine.close())
        table = pd.DataFrame(out, columns=["owner", "start", "end"])
        table.insert(0, "segment", rows["segment"].iloc[0])
        return table

    return run


def control_spans(frames: DataFrame, owners: DataFrame, fps: float, rules: Rules = Rules()) -> DataFrame:
    """Spans (segment, owner, start, end) of stable control. ``frames`` lists all frames of each segment."""
    rows = frames.select("segment", "frame").join(owners, ["segment", "frame"], "left")
    return rows.groupBy("segment").applyInPandas(_spans(*control_frames(rules, fps)), f"segment {dict(rows.dtypes)['segment']}, owner string, start long, end long")


def merge_controls(controls: DataFrame, fps: float, seconds: float = 0.5) -> DataFrame:
    """Join neighbouring spans of one owner that are at most ``seconds`` apart, whoever else holds the ball elsewhere."""
    w = Window.partitionBy("segment").orderBy("start", "end", "owner")
    same = (F.col("owner") == F.lag("owner").over(w)) & (F.col("start") - F.lag("end").over(w) <= round(seconds * fps))
    parts = controls.withColumn("new_", F.when(same, 0).otherwise(1)).withColumn("part_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("segment", "owner", "part_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part_")


def transfers(controls: DataFrame, low: int, high: int) -> DataFrame:
    """Neighbouring control spans of different owners whose gap lies in [low, high] frames."""
    pairs = matching.adjacent(controls.withColumn("order_", F.struct("start", "end", "owner")), ["segment"], "order_", ["owner", "start", "end"])
    gap = F.col("next_start") - F.col("end")
    return pairs.where((F.col("owner") != F.col("next_owner")) & gap.between(low, high)).drop("order_").withColumn("gap", gap)


def observed_paths(pairs: DataFrame, balls: DataFrame, hands: DataFrame, views: list[str], fps: float, rules: Rules = Rules()) -> DataFrame:
    """Transfers whose ball was seen all the way from the giver's hand to the receiver's, in the first view that shows it."""
    margin = round(0.2 * fps)
    key = ["segment", "owner", "next_owner", "end", "next_start"]
    spans = pairs.select(*key, F.explode(F.sequence(F.col("end") - margin, F.col("next_start") + margin - 1)).alias("frame"))
    seen = spans.join(balls.select("segment", "frame", "view", "x", "y"), ["segment", "frame"])
    w = Window.partitionBy(*key, "view").orderBy("frame")
    seen = seen.withColumn("hole", F.col("frame") - F.lag("frame").over(w))
    path = seen.groupBy(*key, "view").agg(F.count("*").alias("n"), F.max("hole").alias("hole"), F.min_by(F.struct("frame", "x", "y"), "frame").alias("a"), F.max_by(F.struct("frame", "x", "y"), "frame").alias("b"))
    moved = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    path = path.where((F.col("n") >= 3) & (F.col("b.frame") - F.col("a.frame") >= 3) & (F.col("hole") <= margin) & (moved >= 25))

    def beside(table: DataFrame, end: str, track: str) -> DataFrame:
        h = hands.select("segment", "view", F.col("frame").alias("f_"), F.col("track").alias("t_"), "height", "wrists")
        joined = table.join(h, ["segment", "view"]).where((F.col("f_") == F.col(f"{end}.frame")) & (F.col("t_") == F.col(track)) & (F.col("height") > 0))
        near = F.exists("wrists", lambda p: (p["confidence"] >= rules.keypoint_confidence) & (F.sqrt(F.pow(p["x"] - F.col(f"{end}.x"), 2) + F.pow(p["y"] - F.col(f"{end}.y"), 2)) < 0.3 * F.col("height")))
        return joined.where(near).drop("f_", "t_", "height", "wrists")

    good = beside(beside(path, "a", "owner"), "b", "next_owner")
    rank = F.array_position(F.array(*map(F.lit, views)), F.col("view"))
    first = good.groupBy(*key).agg(F.min_by(F.struct("view", F.col("a.frame").alias("first"), F.col("b.frame").alias("last"), "n"), rank).alias("path"))
    return first.select(*key, "path.view", "path.first", "path.last", "path.n")


def passages(samples: DataFrame, rims: DataFrame, fps: float, rules: Rules = Rules()) -> DataFrame:
    """Falls of the ball across the rim's line, with what was seen above before and below after.

    ``samples`` has segment, view, frame, x, y, radius; ``rims`` has segment, view, cx, cy, width, height. The
    result says inside, edge or outside. No passage is read across a hole in the observations.
    """
    key = ["segment", "view"]
    hole = fps * rules.observation_gap_seconds + 1e-6
    w = Window.partitionBy(*key).orderBy("frame")
    rows = samples.join(rims, key).withColumns({f"{c}0": F.lag(c).over(w) for c in ("frame", "x", "y", "radius")})
    share = (F.col("cy") - F.col("y0")) / (F.col("y") - F.col("y0"))
    crossed = rows.where((F.col("y0") <= F.col("cy")) & (F.col("y") > F.col("cy")) & (F.col("frame") - F.col("frame0") <= hole))
    crossed = crossed.select(*key, F.col("frame0").alias("f0"), F.col("frame").alias("f1"), (F.col("frame0") + (F.col("frame") - F.col("frame0")) * share).alias("crossing"), (F.col("x0") + (F.col("x") - F.col("x0")) * share).alias("at_x"), F.greatest("radius0", "radius").alias("r"), "cx", "cy", "width", F.col("height").alias("rim_height"))
    crossed = crossed.where(F.abs(F.col("at_x") - F.col("cx")) <= 2 * F.col("width"))
    reach = -fps * max(1.0, rules.passage_seconds), fps * rules.passage_seconds
    near = matching.within(crossed, samples.select(*key, "frame", "x", "y"), key, "crossing", "frame", *reach)
    above = (F.col("frame") <= F.col("f0")) & (F.col("y") < F.col("cy") - F.col("rim_height") / 2 - F.col("r"))
    below = (F.col("frame") >= F.col("f1")) & (F.col("y") > F.col("cy") + F.col("rim_height") / 2 + F.col("r"))
    ids = [*key, "f0", "f1", "crossing", "at_x", "r", "cx", "width"]
    ends = near.groupBy(*ids).agg(F.max(F.when(above, F.col("frame"))).alias("before"), F.min(F.when(below, F.struct("frame", "x"))).alias("after")).where("before is not null and after is not null")
    holes = rows.select(*key, "frame", (F.col("frame") - F.col("frame0") > hole).alias("holed")).where("holed")
    broken = matching.within(ends, holes, key, "crossing", "frame", *reach).where((F.col("frame") > F.col("before")) & (F.col("frame") <= F.col("after.frame"))).select(*key, "f1").distinct()
    off, leave = F.abs(F.col("at_x") - F.col("cx")), F.abs(F.col("after.x") - F.col("cx"))
    result = F.when((off < F.col("width") / 2) & (leave < F.col("width") / 2), "inside").when(off - F.col("r") > F.col("width") / 2, "outside").otherwise("edge")
    return ends.join(broken, [*key, "f1"], "left_anti").select(*key, "crossing", F.col("at_x").alias("x"), result.alias("result"), "before", F.col("after.frame").alias("after"))


def possession_ids(controls: DataFrame, makes: DataFrame, fps: float) -> DataFrame:
    """Number the possessions: a span goes on with the last one of the same known team, soon enough, without a make between."""
    w = Window.partitionBy("segment").orderBy("start", "end", "owner")
    rows = controls.withColumns({"last_end": F.lag("end").over(w), "last_team": F.lag("team").over(w)})
    soon = (F.col("start") - F.col("last_end")).between(0, round(1.2 * fps))
    between = matching.within(rows.where(soon), makes.select("segment", F.col("anchor").alias("a_")), ["segment"], "last_end", "a_", 0, round(1.2 * fps)).where("a_ < start")
    made = between.select("segment", "start", "end", "owner").distinct().withColumn("made_", F.lit(True))
    linked = (F.col("team") == F.col("last_team")) & soon & F.col("made_").isNull()
    rows = rows.join(made, ["segment", "start", "end", "owner"], "left").withColumn("new_", F.when(linked, 0).otherwise(1))
    return rows.withColumn("possession", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("linked", F.col("new_") == 0).drop("made_", "new_", "last_team")


def possession_spans(frames: DataFrame, controls: DataFrame, shots: DataFrame, balls: DataFrame, contacts: DataFrame, fps: float) -> DataFrame:
    """Run-length states of the ball over all frames, by precedence dead, shot flight, pass flight, held or dribble, loose.

    ``controls`` come from ``possession_ids``; ``shots`` has segment, anchor, end, made, resolved; ``balls`` and
    ``contacts`` list (segment, frame) and (segment, frame, owner).
    """
    def spread(spans: DataFrame, *more: str) -> DataFrame:
        return spans.where("s_ < e_").select("segment", F.explode(F.sequence("s_", F.col("e_") - 1)).alias("frame"), *more)

    last = Window.partitionBy("segment", "frame").orderBy(F.desc("start"))
    owned = spread(controls.withColumns({"s_": F.col("start"), "e_": F.col("end")}), "owner", "possession", "team", "start")
    owned = owned.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_", "start")
    moving = spread(controls.where("linked").withColumns({"s_": F.col("last_end"), "e_": F.col("start")}), F.col("possession").alias("p_pass"), F.col("team").alias("t_pass")).dropDuplicates(["segment", "frame"])
    flight = spread(shots.withColumns({"s_": F.col("anchor"), "e_": F.col("end")})).distinct().withColumn("flight", F.lit(True))
    dead = spread(shots.where("made and resolved is not null").withColumns({"s_": F.col("resolved") + 1, "e_": F.col("resolved") + round(fps)})).distinct().withColumn("dead", F.lit(True))
    grid = frames.select("segment", "frame")
    for part in (owned, moving, flight, dead, balls.select("segment", "frame").distinct().withColumn("seen", F.lit(True))):
        grid = grid.join(part, ["segment", "frame"], "left")
    grid = grid.join(contacts.select("segment", "frame", "owner").distinct().withColumn("touch", F.lit(True)), ["segment", "frame", "owner"], "left")
    has, seen = F.col("owner").isNotNull(), F.col("seen").isNotNull()
    state = F.when(F.col("dead"), "dead").when(F.col("flight"), "shot_flight").when(F.col("p_pass").isNotNull() & seen, "pass_flight")
    state = state.when(has & seen & F.col("touch"), "held").when(has & seen, "dribble").when(has, "unknown").when(seen, "loose").otherwise("unknown")
    rows = grid.withColumn("state", state).withColumn("owner", F.when(~F.col("state").isin("dead", "shot_flight"), F.col("owner")))
    live = F.col("state").isin("held", "dribble", "pass_flight", "shot_flight")
    rows = rows.withColumns({"possession": F.when(live, F.coalesce("possession", "p_pass")), "team": F.when(live, F.coalesce("team", "t_pass"))})
    return intervals.run_lengths(rows, ["segment"], "frame", ["state", "owner", "possession", "team"]).drop("run", "n")


def rebounds(misses: DataFrame, shots: DataFrame, controls: DataFrame, fps: float, seconds: float = 5.0) -> DataFrame:
    """First control after each miss, before the next confirmed shot; an acquisition serves one miss.

    Confirmed and later misses choose first. Each miss has one candidate, so the choice is a rank per
    acquisition, not a scan.
    """
    other = shots.where("status = 'confirmed'").select("segment", F.col("anchor").alias("next_"))
    key, reach = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in misses.columns], round(seconds * fps)
    # Shots beyond the reach of a miss do not end it.
    limits = matching.within(misses, other, ["segment"], "resolved", "next_", 0, reach).where("next_ > resolved").groupBy(*misses.columns).agg(F.min("next_").alias("limit"))
    near = matching.within(misses, controls.select("segment", "owner", F.col("start").alias("at_")), ["segment"], "resolved", "at_", 1, reach)
    near = near.join(limits.toDF(*[f"m_{c}" for c in misses.columns], "limit"), reduce(and_, key), "left")
    near = near.where(F.col("limit").isNull() | (F.col("at_") < F.col("limit")))
    first = near.groupBy(*misses.columns).agg(F.min(F.struct("at_", "owner")).alias("c"))
    w = Window.partitionBy("segment", "c").orderBy(F.when(F.col("status") == "confirmed", 0).otherwise(1), F.desc("anchor"))
    return first.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select(*misses.columns, F.col("c.at_").alias("frame"), F.col("c.owner").alias("rebounder")).drop("n_")


def assists(passes: DataFrame, makes: DataFrame, shots: DataFrame, controls: DataFrame, fps: float) -> DataFrame:
    """The latest pass to each scorer within four seconds that no shot and no other player's control interrupts."""
    p = passes.select("segment", F.col("event_id").alias("pass_id"), F.col("anchor").alias("passed"), "passer", "receiver")
    pairs = matching.within(makes.select("segment", "event_id", "anchor", "shooter"), p, ["segment"], "anchor", "passed", -round(4 * fps), 0).where("receiver = shooter")
    def meanwhile(rows: DataFrame) -> DataFrame:
        return matching.within(pairs, rows, ["segment"], "passed", "o_at", 0, round(4 * fps)).where("passed < o_at and o_at < anchor")

    shot = meanwhile(shots.select("segment", F.col("event_id").alias("o_id"), F.col("anchor").alias("o_at"))).where("o_id <> event_id")
    other = meanwhile(controls.select("segment", F.col("owner").alias("o_owner"), F.col("start").alias("o_at"))).where("o_owner <> receiver")
    broken = shot.select("event_id", "pass_id").union(other.select("event_id", "pass_id")).distinct()
    clean = pairs.join(broken, ["event_id", "pass_id"], "left_anti")
    return clean.groupBy("segment", "event_id").agg(F.max_by(F.struct("pass_id", "passer", "passed"), F.struct("passed", "pass_id")).alias("a")).select("segment", "event_id", "a.*")


def follow_ups(actions: DataFrame, shots: DataFrame, actor: str, seconds: float, fps: float, name: str) -> DataFrame:
    """For each action the first shot of the same ``actor`` within ``seconds`` after it, as column ``name``."""
    s = shots.select("segment", F.col("event_id").alias(name), F.col("anchor").alias("shot_at"), F.col(actor).alias("s_actor"))
    pairs = matching.within(actions, s, ["segment"], "anchor", "shot_at", 0, round(seconds * fps)).where(F.col(actor) == F.col("s_actor"))
    return pairs.groupBy("segment", "event_id").agg(F.min_by(name, F.struct("shot_at", name)).alias(name))


def uncovered_visits(visits: DataFrame, shots: DataFrame, fps: float) -> DataFrame:
    """Rim visits that lie neither near a shot nor within one: left anti joins on ranges."""
    peaks, reach = visits.select("segment", "visit", "peak"), round(1.5 * fps)
    near = matching.within(peaks, shots.select("segment", F.col("anchor").alias("a_")), ["segment"], "peak", "a_", -reach, reach)
    held = intervals.point_in_span(peaks, shots.select("segment", "start", "end"), ["segment"], "peak", 256)
    return visits.join(near.select("segment", "visit").union(held.select("segment", "visit")).distinct(), ["segment", "visit"], "left_anti")


def clip_spans(events: DataFrame, controls: DataFrame, fps: float) -> DataFrame:
    """Span of footage for each event: from the stable control it grew out of to some time after its end.

    A control is stable if it lasts 0.2 seconds, up to the event at most; of those before an event the one that ends
    last counts, however long ago, so controls and events are put in one order and the best control is carried along.
    """
    least, anchor = 0.2 * fps, F.col("anchor").cast("double")
    c = controls.where(F.col("end") - F.col("start") >= least).select("segment", F.col("start").cast("double").alias("t_"), F.struct(F.col("end").alias("c_end"), F.col("start").alias("c_start")).alias("c_"))
    asked = events.select("segment", "event_id", F.least(anchor, anchor + 1 - least).alias("t_"))
    # Of equal times the controls come first.
    order = Window.partitionBy("segment").orderBy("t_", F.col("c_").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = c.unionByName(asked, allowMissingColumns=True).withColumn("best_", F.max("c_").over(order))
    best = carried.where("c_ is null and best_ is not null").select("segment", "event_id", F.col("best_.c_start").alias("c_start")).distinct()
    half = F.lit(round(0.5 * fps))
    lead = F.least(F.coalesce(F.col("c_start"), F.col("start")), F.col("start")) - half
    return events.join(best, ["segment", "event_id"], "left").withColumns({"clip_start": F.greatest(lead, F.lit(0)), "clip_end": F.col("end") + F.lit(round(1.5 * fps))}).drop("c_start")


def eligible(candidates: bool = False) -> Column:
    """Whether an event (type, status, outcome_value, outcome_status) may enter a highlight."""
    kind = F.col("type").isin("shot", "rebound", "steal", "block", "successful_drive", "assist_chain")
    shot = F.col("type") == "shot"
    if candidates:
        return kind & ((F.col("status") == "uncertain") | (shot & F.coalesce(F.col("outcome_value") == "unknown", F.lit(False))))
    made = F.coalesce((F.col("outcome_value") == "made") & (F.col("outcome_status") == "confirmed"), F.lit(False))
    return kind & (F.col("status") == "confirmed") & (~shot | made)
