"""From rim visits to shots: releases seen by a view, the proposal that a visit answers, the pass before a release.

Tables carry ``segment``; frames count within it. All joins in time are on a bin with a range condition, and the only
sequential rule (each proposal serves one visit) runs on groups of visits whose windows meet, not on whole segments.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, matching
from .events import Rules

# Joints (wrist, shoulder) of both arms, and the tests of a flight.
ARMS = ((9, 5), (10, 6))
FLIGHT_SECONDS, LEAST_SECONDS, LEAST_SAMPLES, LEAST_COSINE, APPROACH = 0.4, 0.1, 3, 0.5, 0.4
PASS_SECONDS = 1.5
# Fixed values of a moving net: seconds around the anchor, frames before it that may show the arrival, change and frames.
NET_BEFORE, NET_AFTER, NET_MARGIN, NET_LEAST, NET_RISE, NET_FRAMES = 0.5, 0.8, 3, 0.22, 0.16, 3


def raised(keypoints: Column, confidence: float) -> Column:
    """Whether a wrist of ``keypoints`` (array of x, y, confidence) stands above its shoulder in the image."""

    def arm(wrist: int, shoulder: int) -> Column:
        w, s = F.get(keypoints, F.lit(wrist)), F.get(keypoints, F.lit(shoulder))
        finite = [~F.isnan(p[c]) & p[c].isNotNull() for p in (w, s) for c in ("x", "y")]
        sure = (w["confidence"] >= confidence) & (s["confidence"] >= confidence) & (w["y"] < s["y"])
        for f in finite:
            sure &= f
        return F.coalesce(sure, F.lit(False))

    return arm(*ARMS[0]) | arm(*ARMS[1])


def release_views(contacts: DataFrame, poses: DataFrame, samples: DataFrame, rims: DataFrame, fps: float, rules: Rules = Rules()) -> DataFrame:
    """Views in which a contact (segment, player, frame) looks like the release of a shot.

    ``poses`` has segment, frame, view, player, keypoints; ``samples`` segment, view, frame, x, y; ``rims`` segment,
    view, cx, cy, width. A view supports a contact if the hand is raised and the ball, seen without a hole, then
    moves toward the rim. One row for each supporting view.
    """
    key = ["segment", "player", "frame", "view"]
    up = contacts.select("segment", "player", "frame").distinct().join(poses, ["segment", "player", "frame"]).where(raised(F.col("keypoints"), rules.keypoint_confidence)).select(*key).distinct()
    ball = samples.select("segment", "view", F.col("frame").alias("at"), "x", "y")
    seen = matching.within(up, ball, ["segment", "view"], "frame", "at", 0, math.floor(FLIGHT_SECONDS * fps + 1e-9))
    seen = seen.withColumn("hole", F.col("at") - F.lag("at").over(Window.partitionBy(*key).orderBy("at")))
    flight = seen.groupBy(*key).agg(F.count("*").alias("n"), F.max("hole").alias("hole"), F.min_by(F.struct("at", "x", "y"), "at").alias("a"), F.max_by(F.struct("at", "x", "y"), "at").alias("b"))
    flight = flight.where((F.col("n") >= LEAST_SAMPLES) & (F.col("b.at") - F.col("a.at") >= LEAST_SECONDS * fps) & (F.col("hole") <= rules.observation_gap_seconds * fps + 1e-6))
    rows = flight.join(rims.select("segment", "view", "cx", "cy", "width"), ["segment", "view"])
    tx, ty, mx, my = F.col("cx") - F.col("a.x"), F.col("cy") - F.col("a.y"), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    far, moved = F.sqrt(tx * tx + ty * ty), F.sqrt(mx * mx + my * my)
    left = F.sqrt(F.pow(F.col("cx") - F.col("b.x"), 2) + F.pow(F.col("cy") - F.col("b.y"), 2))
    toward = (far * moved > 0) & (tx * mx + ty * my > LEAST_COSINE * far * moved)
    return rows.where(toward & (far - left > APPROACH * F.col("width"))).select(*key)


def _serve(rows: pd.DataFrame) -> pd.DataFrame:
    """Visits in order; each takes the last of its candidates that no earlier visit took."""
    taken: set[tuple] = set()
    chosen = []
    for visit, group in rows.sort_values(["begin", "visit", "release", "player"], kind="stable").groupby(["begin", "visit"], sort=True):
        for release, player in reversed(list(zip(group["release"], group["player"], strict=True))):
            if (release, player) not in taken:
                taken.add((release, player))
                chosen.append((rows["segment"].iloc[0], visit[1], release, player))
                break
    return pd.DataFrame(chosen, columns=["segment", "visit", "release", "player"])


def visit_releases(visits: DataFrame, passages: DataFrame, proposals: DataFrame, controls: DataFrame, fps: float, rules: Rules = Rules()) -> DataFrame:
    """The release that each rim visit (segment, visit, begin, end) answers, with its ``source``.

    Visits without a passage (segment, crossing) nearby are dropped. A visit takes the last free proposal (segment,
    release, player) between a flight before it and its first passage; without one the last control (segment, owner,
    start, end) that ended within a flight before it; without that nothing. Equal releases go by player.
    """
    reach = rules.flight_seconds * fps
    near = _in_span(visits, passages.select("segment", "crossing"), "crossing", rules.passage_seconds * fps)
    first = near.groupBy("segment", "visit", "begin", "end").agg(F.min("crossing").alias("first"))
    # Windows [begin - reach, first) that meet can share proposals: one block each.
    order = Window.partitionBy("segment").orderBy("begin", "visit")
    last = F.max("first").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("begin") - reach < last, 0).otherwise(1)
    blocks = first.withColumn("new_", new).withColumn("block", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    offered = _in_span(blocks.withColumnRenamed("end", "end_").withColumn("end", F.col("first")), proposals.select("segment", "release", "player").distinct(), "release", reach).where("release < first")
    types = dict(offered.dtypes)
    schema = f"segment {types['segment']}, visit {types['visit']}, release {types['release']}, player {types['player']}"
    served = offered.select("segment", "block", "visit", "begin", "release", "player").groupBy("segment", "block").applyInPandas(_serve, schema)
    held = matching.within(first.select("segment", "visit", "begin"), controls.select("segment", "owner", "start", (F.col("end") - 1).alias("let_go")), ["segment"], "begin", "let_go", -reach, 0)
    held = held.groupBy("segment", "visit").agg(F.max_by(F.struct("let_go", "owner"), F.struct("start", "let_go", "owner")).alias("held_"))
    rows = first.join(served, ["segment", "visit"], "left").join(held, ["segment", "visit"], "left")
    source = F.when(F.col("release").isNotNull(), "proposal").when(F.col("held_").isNotNull(), "control")
    return rows.select("segment", "visit", "begin", "end", "first", F.coalesce("release", "held_.let_go").alias("release"), F.coalesce("player", "held_.owner").alias("player"), source.alias("source"))


def _in_span(spans: DataFrame, points: DataFrame, at: str, before: float, size: int = 256) -> DataFrame:
    """Pairs of spans and points of one segment with ``at`` in [begin - before, end], joined by bins of frames."""
    bins = F.sequence(F.floor((F.col("begin") - before) / size), F.floor(F.col("end") / size))
    left = spans.withColumn("bin_", F.explode(bins))
    right = points.withColumn("bin_", F.floor(F.col(at) / size))
    return left.join(right, ["segment", "bin_"]).where(F.col(at).between(F.col("begin") - before, F.col("end"))).drop("bin_")


def passes_before(shots: DataFrame, controls: DataFrame, anchors: DataFrame, fps: float) -> DataFrame:
    """The pass that led to each shot (segment, event_id, release, player), where there is one.

    The last control (segment, owner, start, end, team) begun by the release must be the shooter's, the one before it
    a known team mate's; both gaps last at most 1.5 seconds and no event (``anchors``: segment, anchor) lies between.
    Repeated controls count once; ties go by end, owner and team.
    """
    most = round(PASS_SECONDS * fps)
    w = Window.partitionBy("segment").orderBy("start", "end", "owner", "team")
    held = controls.select("segment", "owner", "start", "end", "team").distinct().withColumns({"passer": F.lag("owner").over(w), "left_": F.lag("end").over(w), "t_": F.lag("team").over(w)})
    found = matching.within(shots.select("segment", "event_id", "release", "player"), held, ["segment"], "release", "start", -most, 0)
    last = found.groupBy("segment", "event_id", "release", "player").agg(F.max_by(F.struct("owner", "start", "team", "passer", "left_", "t_"), F.struct("start", "end", "owner", "team")).alias("c"))
    gap = F.col("c.start") - F.col("c.left_")
    good = last.where((F.col("c.owner") == F.col("player")) & (F.col("c.passer") != F.col("player")) & (F.col("c.team") == F.col("c.t_")) & gap.between(0, most))
    good = good.select("segment", "event_id", F.col("c.passer").alias("passer"), F.col("player").alias("receiver"), F.col("c.left_").alias("left_"), F.col("c.start").alias("start_"))
    broken = matching.within(good, anchors.select("segment", "anchor"), ["segment"], "left_", "anchor", 0, most).where("anchor < start_").select("segment", "event_id").distinct()
    return good.join(broken, ["segment", "event_id"], "left_anti").select("segment", "event_id", "passer", "receiver", (F.col("left_") - 1).alias("frame"))


def net_moved(anchors: DataFrame, net: DataFrame, fps: float) -> DataFrame:
    """``anchors`` (segment, anchor, ...) with baseline, threshold, sustained and moved: whether the net moved after them.

    ``net`` has segment, frame and change, the share of the net's visible texture that differs from its rest; null where
    too little of it is seen. The frames from half a second before to three frames before the anchor are its rest, the
    following ones up to 0.8 seconds after show it moving if three in a row reach the threshold. Without three frames of
    rest and one after there is no movement.
    """
    before, after = round(NET_BEFORE * fps), round(NET_AFTER * fps)
    keys = anchors.columns
    seen = matching.within(anchors, net.select("segment", "frame", "change"), ["segment"], "anchor", "frame", -before, after - 1)
    rest = F.col("frame") < F.col("anchor") - NET_MARGIN
    w = Window.partitionBy(*keys)
    rows = seen.withColumn("baseline", F.coalesce(F.percentile(F.when(rest, F.col("change")), 0.5).over(w), F.lit(0.0)))
    rows = rows.withColumn("threshold", F.greatest(F.lit(NET_LEAST), F.col("baseline") + NET_RISE))
    rows = rows.withColumn("high_", F.coalesce(~rest & (F.col("change") >= F.col("threshold")), F.lit(False)))
    # Frames in a row: rows that are not high number the runs between them.
    lows = F.sum(F.when(F.col("high_"), 0).otherwise(1)).over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("run_", lows).groupBy(*keys, "baseline", "threshold", "run_").agg(F.count_if("high_").alias("n"), F.count_if(rest).alias("rest_"), F.count_if(~rest).alias("after_"))
    found = runs.groupBy(*keys, "baseline", "threshold").agg(F.max("n").alias("sustained"), F.sum("rest_").alias("rest_"), F.sum("after_").alias("after_"))
    moved = (F.col("sustained") >= NET_FRAMES) & (F.col("rest_") >= 3) & (F.col("after_") >= 1)
    return found.withColumn("moved", moved).drop("rest_", "after_")


def outcomes(visits: DataFrame, passages: DataFrame, net: DataFrame, fps: float, result_view: str, least_views: int = 1, views: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """Outcome, confidence and resolution frame of every visit (segment, visit, begin, end) with a passage nearby.

    ``passages`` has segment, view, crossing, result. Passages inside the rim form groups that last ``passage_seconds``
    from their first one. A group can be a make if two views agree (``least_views`` if more), or the result view alone
    where ``least_views`` allows it, and no view sees the ball outside at the time; the first such group after which
    the net moves is the make, at the result view's passage if it has one. Without any group's net moving the outcome is
    unknown, unconfirmed if there was a group. Two views that see the ball outside together, and none that sees it
    inside, confirm a miss; of several such moments the first view's first one (``views`` in order, else by name).
    """
    key = ["segment", "visit"]
    seen = _in_span(visits.select(*key, "begin", "end"), passages.select("segment", "view", "crossing", "result"), "crossing", rules.passage_seconds * fps)
    inside, outside = seen.where("result = 'inside'"), seen.where("result = 'outside'").select(*key, F.col("view").alias("o_view"), F.col("crossing").alias("o_at"))
    groups = intervals.anchored_groups(inside.select(*key, "crossing"), key, "crossing", rules.passage_seconds * fps).select(*key, "part", F.col("start").alias("from_"), F.col("end").alias("to_"))
    held = inside.join(groups, key).where("crossing between from_ and to_").groupBy(*key, "part")
    held = held.agg(F.percentile("crossing", 0.5).alias("t"), F.percentile(F.when(F.col("view") == result_view, F.col("crossing")), 0.5).alias("own"), F.count_distinct("view").alias("n"))
    fusion = rules.fusion_seconds * fps
    against = held.join(outside, key).where(F.abs(F.col("o_at") - F.col("t")) <= fusion).select(*key, "part").distinct()
    enough = (F.col("n") >= max(2, least_views)) | (F.col("own").isNotNull() & F.lit(least_views <= 1))
    could = held.where(enough).join(against, [*key, "part"], "left_anti").select(*key, "part", F.bround(F.coalesce("own", "t")).cast("long").alias("anchor"))
    moved = net_moved(could, net, fps).where("moved").groupBy(*key).agg(F.min_by("anchor", "part").alias("made_at"))
    doubtful = could.select(*key, F.lit(True).alias("doubt")).distinct()

    others = outside.select(*key, F.col("o_view").alias("v2"), F.col("o_at").alias("t2"))
    near = outside.distinct().join(others, key).where(F.abs(F.col("o_at") - F.col("t2")) <= fusion).groupBy(*key, "o_view", "o_at").agg(F.percentile("t2", 0.5).alias("t"), F.count_distinct("v2").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, views)), F.col("o_view")) if views else F.lit(0)
    missed = near.where("n >= 2").join(inside.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.bround(F.min_by("t", F.struct(rank, "o_view", "o_at"))).cast("long").alias("missed_at"))
    rows = seen.select(*key).distinct().join(moved, key, "left").join(missed, key, "left").join(doubtful, key, "left")
    outcome = F.when(F.col("made_at").isNotNull(), "made").when(F.col("missed_at").isNotNull(), "missed").otherwise("unknown")
    confidence = F.when(outcome != "unknown", "confirmed").when(F.col("doubt"), "unconfirmed").otherwise("probable")
    return rows.select(*key, outcome.alias("outcome"), confidence.alias("confidence"), F.coalesce("made_at", "missed_at").alias("resolution"))


def detect_shots(contacts: DataFrame, poses: DataFrame, samples: DataFrame, rims: DataFrame, passages: DataFrame, visits: DataFrame, controls: DataFrame, net: DataFrame, fps: float, result_view: str, least_views: int = 1, views: tuple[str, ...] = (), rules: Rules = Rules()) -> DataFrame:
    """Shots from contacts to outcomes: release, shooter, views, outcome and the pass before.

    One for each visit with a passage, and one of unknown outcome for each proposal that no visit takes. The anchor is
    the release, or the begin of the visit where no release is known; ``number`` counts the shots of a segment by it,
    those of visits first.
    """
    seen = release_views(contacts, poses, samples, rims, fps, rules).groupBy("segment", "player", F.col("frame").alias("release")).agg(F.array_sort(F.collect_set("view")).alias("views"))
    shots = visit_releases(visits, passages, seen.select("segment", "release", "player"), controls, fps, rules)
    shots = shots.join(seen, ["segment", "release", "player"], "left").withColumn("views", F.when(F.col("source") == "proposal", F.col("views")))
    shots = shots.join(outcomes(visits, passages, net, fps, result_view, least_views, views, rules), ["segment", "visit"], "left")
    taken = shots.where("source = 'proposal'").select("segment", "release", "player")
    left = seen.join(taken, ["segment", "release", "player"], "left_anti").withColumns({"source": F.lit("proposal"), "outcome": F.lit("unknown"), "confidence": F.lit("probable")})
    shots = shots.drop("first").unionByName(left, allowMissingColumns=True).withColumn("anchor", F.coalesce("release", "begin"))
    w = Window.partitionBy("segment").orderBy("anchor", F.col("visit").isNull(), "begin", "visit", "release", "player")
    shots = shots.withColumn("number", F.row_number().over(w))
    led = passes_before(shots.where("release is not null").withColumn("event_id", F.col("number")), controls, shots, fps).select("segment", F.col("event_id").alias("number"), "passer", F.col("frame").alias("passed"))
    return shots.join(led, ["segment", "number"], "left").select("segment", "number", "visit", "begin", "end", "anchor", "release", "player", "source", "views", "outcome", "confidence", "resolution", "passer", "passed")


def drive_proposals(controls: DataFrame, tracks: DataFrame, rims: DataFrame, fps: float) -> DataFrame:
    """Controls in which the owner passes a defender on the way to the rim, judged in each view's image.

    ``tracks`` has segment, frame, view, track, x, y. Every view names its first (least) passed defender; the one named
    by most views is given, the least of equals. The image shows no ground plane, so all rows stay proposals.
    """
    spans = controls.where(F.col("end") - F.col("start") >= round(0.65 * fps)).select("segment", "owner", "start", "end")

    def beside(rows: DataFrame, frame: Column, name: str, keys: list[str]) -> DataFrame:
        t = tracks.select("segment", F.col("frame").alias("f_"), "view", F.col("track").alias("t_"), F.struct("x", "y").alias(name))
        return rows.withColumn("f_", frame).join(t, ["segment", "f_", *keys]).drop("f_")

    def apart(a: str, b: str) -> Column:
        return F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2))

    first, last = F.col("start"), F.col("end") - 1
    rows = beside(spans.withColumn("t_", F.col("owner")), first, "p0", ["t_"])
    rows = beside(rows, last, "p1", ["t_", "view"]).drop("t_")
    rows = rows.join(rims.select("segment", "view", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("rim"), "width"), ["segment", "view"])
    rows = rows.withColumn("progress", apart("p0", "rim") - apart("p1", "rim")).where(F.col("progress") >= 0.55 * F.col("width"))
    rows = beside(rows, first, "d0", ["view"]).where("t_ <> owner")
    rows = beside(rows, last, "d1", ["view", "t_"])
    passed = (apart("d0", "rim") < apart("p0", "rim")) & (apart("d0", "p0") < 1.8 * F.col("width")) & (apart("p1", "rim") + 0.3 * F.col("width") < apart("d1", "rim"))
    key = ["segment", "owner", "start", "end"]
    named = rows.where(passed).groupBy(*key, "view").agg(F.min("t_").alias("defender"))
    votes = named.groupBy(*key, "defender").agg(F.count("*").alias("views"))
    best = votes.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("views"), "defender"))).where("n_ = 1")
    return best.select(*key, "defender", "views", F.lit("uncertain").alias("status"))
