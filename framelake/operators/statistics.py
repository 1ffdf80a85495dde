"""Box scores, evaluation figures and robust aggregates, with their integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching

#: Counted metrics in report order, and the roles of each event type.
METRICS = (
    "shot_attempts_detected", "made", "missed", "outcome_unknown", "made_inside_arc", "made_outside_arc", "zone_unknown",
    "rebounds_total", "rebounds_offensive", "rebounds_defensive", "rebounds_team_unknown", "steals", "blocks",
    "successful_drives", "assist_chains", "passes", "receptions",
)
ROLES = {
    "shot": ("shooter",),
    "rebound": ("rebounder",),
    "steal": ("stealer",),
    "block": ("blocker",),
    "successful_drive": ("driver",),
    "assist_chain": ("passer",),
    "pass": ("passer", "receiver"),
}


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out &= c
    return out


def _flags() -> dict[str, Column]:
    """Whether a row (type, role, outcome, zone, side) counts for each metric; null conditions don't count."""
    kind, known = F.col("type"), lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    shot, rebound, made = kind == "shot", kind == "rebound", known("outcome", "made")
    return {
        "shot_attempts_detected": shot,
        "made": _all(shot, made),
        "missed": _all(shot, known("outcome", "missed")),
        "outcome_unknown": _all(shot, ~known("outcome", "made", "missed")),
        "made_inside_arc": _all(shot, made, known("zone", "inside_arc")),
        "made_outside_arc": _all(shot, made, known("zone", "outside_arc")),
        "zone_unknown": _all(shot, made, ~known("zone", "inside_arc", "outside_arc")),
        "rebounds_total": rebound,
        "rebounds_offensive": _all(rebound, known("side", "offensive")),
        "rebounds_defensive": _all(rebound, known("side", "defensive")),
        "rebounds_team_unknown": _all(rebound, ~known("side", "offensive", "defensive")),
        "steals": kind == "steal",
        "blocks": kind == "block",
        "successful_drives": kind == "successful_drive",
        "assist_chains": kind == "assist_chain",
        "passes": _all(kind == "pass", F.col("role") == "passer"),
        "receptions": _all(kind == "pass", F.col("role") == "receiver"),
    }


def reject_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as they are; the query fails when it meets a second row of one key."""
    w = Window.partitionBy(key)
    checked = rows.withColumn("copies_", F.count("*").over(w))
    return checked.where(F.when(F.col("copies_") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("copies_")


def box_score(events: DataFrame, players: DataFrame) -> DataFrame:
    """Counts by player, for ``unassigned`` and for ``all_players``.

    ``events`` has event_id, type, status, outcome (value, status), zone, side and actor_roles: a map from role
    to a struct of player_id, role_status, identity_status. A role counts for a player of ``players`` (player_id)
    when both statuses are confirmed, otherwise for ``unassigned``; every role counts once in the total. The
    three levels come from one aggregate over grouping sets.
    """
    events = reject_duplicates(events, "event_id")
    roles = F.explode(F.element_at(F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("type")))
    counted = events.where((F.col("status") == "confirmed") & F.col("type").isin(*ROLES)).withColumn("role", roles)
    actor = F.try_element_at("actor_roles", F.col("role"))
    outcome = F.when(F.col("outcome.status") == "confirmed", F.col("outcome.value"))
    sure = (actor["role_status"] == "confirmed") & (actor["identity_status"] == "confirmed")
    flat = counted.select("event_id", "type", "role", "zone", "side", outcome.alias("outcome"), F.when(sure, actor["player_id"]).alias("pid"))
    named = flat.join(players.select(F.col("player_id").alias("known")), F.col("pid") == F.col("known"), "left").withColumn("player", F.coalesce("known", F.lit("unassigned")))
    sums = [F.count_if(c).alias(m) for m, c in _flags().items()]
    counts = named.groupingSets([["player"], []], "player").agg(*sums, F.grouping("player").alias("level_"))
    rows = counts.withColumn("player", F.when(F.col("level_") == 1, "all_players").otherwise(F.col("player"))).drop("level_")
    wanted = players.select(F.col("player_id").alias("player")).union(players.sparkSession.createDataFrame([("all_players",), ("unassigned",)], "player string"))
    return ratios(wanted.join(rows, "player", "left").na.fill(0, list(METRICS)))


def ratios(rows: DataFrame) -> DataFrame:
    """Adds resolved_fg_pct and outcome_coverage (4 places, null without a base) after checking that parts add up."""
    resolved = F.col("made") + F.col("missed")
    parts = (F.col("shot_attempts_detected") == resolved + F.col("outcome_unknown")) & (F.col("rebounds_total") == F.col("rebounds_offensive") + F.col("rebounds_defensive") + F.col("rebounds_team_unknown"))
    checked = rows.where(F.when(~parts, F.raise_error(F.lit("parts do not add up to their total")).cast("boolean")).otherwise(F.lit(True)))
    return checked.withColumns({
        "resolved_fg_pct": F.round(F.try_divide("made", resolved), 4),
        "outcome_coverage": F.round(F.try_divide(resolved, F.col("shot_attempts_detected")), 4),
    })


def conserved(stats: DataFrame) -> DataFrame:
    """Metrics whose total differs from the sum over players and unassigned; empty when all is right."""
    own = F.when(F.col("player") != "all_players", 1).otherwise(0)
    long = stats.select("player", F.expr("stack({}, {}) as (metric, n)".format(len(METRICS), ", ".join(f"'{m}', cast({m} as bigint)" for m in METRICS))))
    sums = long.withColumn("own", own).groupBy("metric").agg(F.sum(F.col("n") * F.col("own")).alias("parts"), F.sum(F.col("n") * (1 - F.col("own"))).alias("total"))
    return sums.where("parts <> total")


def uncertain_counts(events: DataFrame) -> DataFrame:
    """Map of type to number of uncertain events, for each role's player and in total."""
    open_ = events.where("status = 'uncertain'")
    total = open_.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("all_players").alias("player"), "type", "n")
    roles = F.explode_outer("actor_roles")
    own = open_.select("type", roles.alias("role", "actor")).where(F.array_contains(F.element_at(F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("type")), F.col("role")))
    own = own.groupBy(F.coalesce("actor.player_id", F.lit("unassigned")).alias("player"), "type").agg(F.count("*").alias("n"))
    return total.union(own).groupBy("player").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("uncertain"))


def retrieval_figures(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """precision, recall and f1 of summed tp, predicted, slots; null where a base is empty."""
    sums = counts.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("slots").alias("slots"))
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "slots")
    return sums.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("slots") - F.col("tp"), "precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)})


def robust_mean(rows: DataFrame, keys: Sequence[str], x: str, y: str, floor: float = 0.35, scale: float = 2.5, least_mad: float = 0.05, least: int = 2) -> DataFrame:
    """Median position of each key after rows far from the median have gone.

    With three rows or more, rows beyond max(floor, median distance + scale * max(MAD, least_mad)) of the component
    median are outliers; where fewer than ``least`` stay, all rows count.
    """
    w = Window.partitionBy(*keys)
    dist = rows.withColumns({"mx": F.percentile(x, 0.5).over(w), "my": F.percentile(y, 0.5).over(w), "n_": F.count("*").over(w)})
    dist = dist.withColumn("d", F.sqrt(F.pow(F.col(x) - F.col("mx"), 2) + F.pow(F.col(y) - F.col("my"), 2)))
    dist = dist.withColumn("md", F.percentile("d", 0.5).over(w)).withColumn("mad", F.percentile(F.abs(F.col("d") - F.col("md")), 0.5).over(w))
    gate = F.greatest(F.lit(floor), F.col("md") + scale * F.greatest(F.col("mad"), F.lit(least_mad)))
    ok = dist.withColumn("ok", (F.col("n_") < 3) | (F.col("d") <= gate)).withColumn("n_ok", F.count_if("ok").over(w))
    return ok.where(F.col("ok") | (F.col("n_ok") < least)).groupBy(*keys).agg(F.percentile(x, 0.5).alias(x), F.percentile(y, 0.5).alias(y), F.count("*").alias("used"))


def mean_unit_vector(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean of unit vectors, scaled to unit length again."""
    long = rows.select(*keys, vector, F.posexplode(vector).alias("i", "v_"))
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    mean = long.where(size > 0).groupBy(*keys, "i").agg(F.avg(F.col("v_") / size).alias("m"))
    unit = mean.withColumn("u", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(*keys))))
    return unit.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "u"))), lambda s: s["u"]).alias("unit"))


def split_into_teams(transfers: DataFrame, least: int = 18, share: float = 0.15, margin: int = 6) -> DataFrame:
    """The two sides of three with most transfers inside less those across, if clear enough.

    ``transfers`` has group, a, b, one row for each transfer; groups with six players have ten splits, which are
    listed and scored by one aggregate. Null teams mean that no split is clear.
    """
    players = transfers.select("group", F.explode(F.array("a", "b")).alias("p")).groupBy("group").agg(F.sort_array(F.collect_set("p")).alias("six")).where(F.size("six") == 6)
    pairs = [(i, j) for i in range(1, 6) for j in range(i + 1, 6)]
    splits = players.withColumn("split", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])))
    splits = splits.withColumn("one", F.array(F.col("six")[0], F.element_at("six", F.col("split.i") + 1), F.element_at("six", F.col("split.j") + 1)))
    scored = transfers.where("a <> b").join(splits, "group").withColumn("inside", F.array_contains("one", F.col("a")) == F.array_contains("one", F.col("b")))
    score = scored.groupBy("group", "one", "six").agg(F.sum(F.when(F.col("inside"), 1).otherwise(-1)).alias("score"), F.count("*").alias("total"))
    w = Window.partitionBy("group").orderBy(F.desc("score"), "one")
    best = score.withColumns({"n": F.row_number().over(w), "second": F.lead("score").over(w)}).where("n = 1")
    clear = (F.col("total") >= least) & (F.col("score") >= share * F.col("total")) & (F.col("score") - F.col("second") >= F.greatest(F.lit(float(margin)), share * F.col("total")))
    return best.select("group", F.when(clear, F.col("one")).alias("team_1"), F.when(clear, F.array_except("six", "one")).alias("team_2"), "score", "second", "total")


def greedy_budget(clips: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Whole clips (clip, score, length) by falling score, shorter first, that still fit the budget."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "length", "clip")))
    listed = clips.groupBy(*keys).agg(ranked.alias("all"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = x["length"] <= s["left"]
        return F.struct(F.when(fits, s["left"] - x["length"]).otherwise(s["left"]).cast("long").alias("left"), F.when(fits, F.concat(s["out"], F.array(x["clip"].cast("bigint")))).otherwise(s["out"]).alias("out"))

    return listed.select(*keys, F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("clip"))


def spaced_sample(rows: DataFrame, keys: Sequence[str], order: str, bins: int, spacing: int) -> DataFrame:
    """Best-scored row of each of ``bins`` equal parts of a key's span, kept if ``spacing`` after the last one kept."""
    w = Window.partitionBy(*keys)
    low, high = F.min(order).over(w), F.max(order).over(w)
    placed = rows.withColumn("bin_", F.least(F.floor((F.col(order) - low) * bins / F.greatest(high - low, F.lit(1))), F.lit(bins - 1)))
    best = placed.groupBy(*keys, "bin_").agg(F.max_by(F.col(order), F.struct("score", -F.col(order))).alias("at"))
    listed = best.groupBy(*keys).agg(F.sort_array(F.collect_list("at")).alias("all"))
    kept = F.aggregate("all", F.array().cast("array<bigint>"), lambda s, x: F.when((F.size(s) == 0) | (x - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) >= spacing), F.concat(s, F.array(x.cast("bigint")))).otherwise(s))
    return listed.select(*keys, F.explode(kept).alias(order))


def stratified_sample(rows: DataFrame, keys: Sequence[str], bins: int = 6, most: int = 6, spacing: int = 120) -> DataFrame:
    """Frames that show a key over all of its span: (keys, frame, view, rank) of rows (keys, frame, view, score, begin, last).

    Only the view with most rows counts (of equals that of the best row). The best row of each of ``bins`` parts of
    [begin, last] comes first, then the others by falling score; a row is taken if it is ``spacing`` frames from all
    taken ones, until there are ``most``. Equal scores go to the later frame.
    """
    w = Window.partitionBy(*keys)
    views = rows.groupBy(*keys, "view").agg(F.count("*").alias("n"), F.max(F.struct("score", "frame", "view")).alias("top"))
    chosen = views.groupBy(*keys).agg(F.max_by("view", F.struct("n", "top")).alias("view"))
    kept = rows.join(chosen, [*keys, "view"])
    width = F.greatest(F.floor((F.col("last") - F.col("begin") + 1) / bins), F.lit(1))
    kept = kept.withColumn("bin_", F.least(F.floor((F.col("frame") - F.col("begin")) / width), F.lit(bins - 1)))
    first = F.row_number().over(Window.partitionBy(*keys, "bin_").orderBy(F.desc("score"), F.desc("frame"))) == 1
    order = F.struct(F.when(F.col("first_"), F.col("bin_")).otherwise(bins).alias("part"), (-F.col("score")).alias("s"), (-F.col("frame")).alias("f"))
    ranked = kept.withColumn("first_", first).select(*keys, "frame", "view", order.alias("o"))
    listed = ranked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", F.col("frame").cast("long").alias("frame")))), lambda x: x["frame"]).alias("all"), F.first("view").alias("view"))

    def take(s: Column, x: Column) -> Column:
        near = F.exists(s, lambda y: F.abs(x - y) < spacing)
        return F.when((F.size(s) >= most) | near, s).otherwise(F.concat(s, F.array(x)))

    taken = F.aggregate("all", F.array().cast("array<bigint>"), take)
    return listed.select(*keys, "view", F.posexplode(taken).alias("rank", "frame")).withColumn("rank", F.col("rank") + 1)


def ground_positions(asked: DataFrame, rows: DataFrame, reach: int = 2, least: int = 3, views: int = 2, error: float = 30.0) -> DataFrame:
    """Median place (x, y) of each asked (segment, frame, track) over the frames around it, from sound rows only.

    ``rows`` has segment, frame, track, x, y, predicted, views, error. Sound is a finite place, not predicted, of enough
    views and a small error; fewer than ``least`` sound rows give no place.
    """
    sound = ~F.coalesce(F.col("predicted"), F.lit(False)) & (F.col("views") >= views) & (F.col("error") < error)
    for c in "xy":
        sound &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    key = ["segment", "track"]
    near = matching.within(asked.select(*key, "frame").distinct(), rows.where(sound).select(*key, F.col("frame").alias("at_"), "x", "y"), key, "frame", "at_", -reach, reach)
    found = near.groupBy(*key, "frame").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)
