"""Evidence for defensive and driving events: contacts of several views, deflections, advances past a defender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching


def opposed(a: Column, b: Column) -> Column:
    """Both sides known and different; an unknown side opposes no one."""
    return F.coalesce(a != b, F.lit(False))


def deflections(balls: DataFrame, reach: int = 5, hole: int = 3, least_speed: float = 1.0, most: float = 0.4) -> DataFrame:
    """Frames where a view's ball (segment, view, frame, x, y) turns: cosine of in and out movement at most ``most``."""
    w = Window.partitionBy("segment", "view").orderBy(F.col("frame").cast("long"))
    before, after = w.rangeBetween(-reach, 0), w.rangeBetween(0, reach)
    seen = balls.withColumn("gap_", F.col("frame") - F.lag("frame").over(w))
    rows = seen.withColumns({
        "f0": F.first("frame").over(before), "x0": F.first("x").over(before), "y0": F.first("y").over(before),
        "f1": F.last("frame").over(after), "x1": F.last("x").over(after), "y1": F.last("y").over(after),
        "h_": F.max("gap_").over(w.rangeBetween(-reach + 1, reach)),
    })
    ax, ay, bx, by = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    sa = F.sqrt(ax * ax + ay * ay) / F.nullif(F.col("frame") - F.col("f0"), F.lit(0))
    sb = F.sqrt(bx * bx + by * by) / F.nullif(F.col("f1") - F.col("frame"), F.lit(0))
    cosine = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    ok = (sa >= least_speed) & (sb >= least_speed) & (F.col("h_") <= hole)
    return rows.where(ok).withColumn("cosine", cosine).where(F.col("cosine") <= most).select("segment", "view", "frame", "cosine")


def steals(pairs: DataFrame, touches: DataFrame, turns: DataFrame, fps: float) -> DataFrame:
    """Judge transfers (segment, owner, next_owner, end, next_start, team, next_team) as steals.

    ``touches`` has segment, frame, view, track. The best frame near the take-over is the one with most views of
    contact, then most with a deflection within two frames; a steal needs two of contact, one deflection, a touch
    of the same player up to three frames before the turn, opposed teams and a lasting hold.
    """
    near = matching.within(pairs, touches.select("segment", F.col("frame").alias("at"), "view", "track"), ["segment"], "next_start", "at", -round(0.5 * fps), round(0.2 * fps)).where("track = next_owner")
    key = ["segment", "owner", "next_owner", "end", "next_start"]
    t = turns.select("segment", "view", F.col("frame").alias("turned"))
    # A turn counts up to two frames before and three after a contact.
    paired = matching.within(near.select(*key, "at", "view").distinct(), t, ["segment", "view"], "at", "turned", -2, 3)
    turned = paired.groupBy(*key, "at").agg(F.count_distinct(F.when(F.abs(F.col("turned") - F.col("at")) <= 2, F.col("view"))).alias("turns"), F.max(F.when(F.col("turned") >= F.col("at"), True)).alias("prior"))
    frames = near.groupBy(*key, "at").agg(F.count_distinct("view").alias("views")).join(turned, [*key, "at"], "left").fillna(0, ["turns"])
    best = frames.groupBy(*key).agg(F.max_by(F.struct("at", "views", "turns", "prior"), F.struct("views", "turns", -F.col("at"))).alias("b"))
    judged = pairs.join(best, key, "left").withColumn("hold", F.col("next_end") - F.col("next_start"))
    tests = {
        "TEAM_RELATION_UNKNOWN": ~opposed(F.col("team"), F.col("next_team")),
        "CONTACT_UNVERIFIED": F.coalesce(F.col("b.views"), F.lit(0)) < 2,
        "DEFLECTION_UNVERIFIED": F.coalesce(F.col("b.turns"), F.lit(0)) < 1,
        "NO_PRIOR_TOUCH": F.col("b.prior").isNull(),
        "CONTROL_TOO_BRIEF": F.col("hold") < round(0.25 * fps),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()]))
    return judged.select(*key, F.col("b.at").alias("frame"), F.col("b.views").alias("views"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("confirmed"))


def blocks(shots: DataFrame, touches: DataFrame, turns: DataFrame, fps: float) -> DataFrame:
    """Best defensive contact with a deflection around each shot (segment, event_id, anchor, shooter, team, outcome).

    ``touches`` has segment, frame, view, track, team. Most views, then nearest to the shot. A made shot rejects it;
    two views of an opponent confirm it.
    """
    # Only touches with a deflection count, and shots of one player at one frame meet the same ones.
    near = touches.join(turns.select("segment", "view", "frame").distinct(), ["segment", "view", "frame"], "left_semi")
    hits = near.groupBy("segment", "frame", "track", "team").agg(F.count_distinct("view").alias("views"))
    taken = shots.select("segment", "anchor", "shooter").distinct()
    met = matching.within(taken, hits.select("segment", F.col("frame").alias("at"), "track", F.col("team").alias("t_team"), "views"), ["segment"], "anchor", "at", -8, round(0.8 * fps) - 1)
    order = F.struct("views", -F.abs(F.col("at") - F.col("anchor")), -F.col("at"))
    found = met.where("track <> shooter").groupBy("segment", "anchor", "shooter").agg(F.max_by(F.struct("at", "track", "t_team", "views"), order).alias("m"), F.max(order).alias("o"))
    best = shots.join(found, ["segment", "anchor", "shooter"]).groupBy("segment", "event_id", "team", "outcome").agg(F.max_by("m", "o").alias("b"))
    strong = (F.col("b.views") >= 2) & opposed(F.col("team"), F.col("b.t_team"))
    status = F.when(F.coalesce(F.col("outcome") == "made", F.lit(False)), "rejected").when(strong, "confirmed").otherwise("uncertain")
    return best.select("segment", "event_id", F.col("b.at").alias("frame"), F.col("b.track").alias("blocker"), F.col("b.views").alias("views"), status.alias("status"))


def drives(controls: DataFrame, ground: DataFrame, basket: tuple[float, float], fps: float, least_seconds: float = 0.65, advance: float = 0.9, close: float = 2.0) -> DataFrame:
    """First defender that each controller (segment, owner, start, end) passes on the way to the basket.

    ``ground`` has segment, frame, track, x, y, team. At the begin the defender is close and not farther from the
    basket than the owner; at a later frame the owner is nearer by ``advance`` and nearer than the defender. Frames
    meet by key, so each control is compared with the defenders of its own frames only.
    """
    d = F.sqrt(F.pow(F.col("x") - basket[0], 2) + F.pow(F.col("y") - basket[1], 2))
    g = ground.withColumn("d_", d)
    long = controls.where(F.col("end") - F.col("start") >= round(least_seconds * fps))
    own = long.join(g.select("segment", F.col("frame").alias("f_"), F.col("track").alias("owner"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("d_").alias("od"), F.col("team").alias("o_team")), ["segment", "owner"]).where("f_ >= start and f_ < end")
    other = g.select("segment", F.col("frame").alias("f_"), F.col("track").alias("defender"), "x", "y", F.col("d_").alias("dd"), F.col("team").alias("d_team"))
    met = own.join(other, ["segment", "f_"]).where(F.col("defender") != F.col("owner"))
    key = ["segment", "owner", "start", "end", "defender"]
    begins = met.where(opposed(F.col("o_team"), F.col("d_team")) & (F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)) <= close) & (F.col("dd") <= F.col("od"))).groupBy(*key).agg(F.min(F.struct("f_", "od")).alias("a"))
    ends = met.select(*key, "f_", "od", "dd").join(begins, key).where((F.col("f_") > F.col("a.f_")) & (F.col("a.od") - F.col("od") >= advance) & (F.col("od") < F.col("dd")))
    first = ends.groupBy("segment", "owner", "start", "end").agg(F.min(F.struct(F.col("a.f_").alias("begin"), "defender", F.col("f_").alias("finish"), (F.col("a.od") - F.col("od")).alias("advance"))).alias("m"))
    return first.select("segment", "owner", "start", "end", "m.*")


def acquisitions(options: DataFrame, touches: DataFrame, fps: float) -> DataFrame:
    """The first control of each miss (segment, miss, owner, start, end): stable, or brief with a touch in two views."""
    w = Window.partitionBy("segment", "miss").orderBy("start", "owner")
    first = options.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
    seen = matching.within(first, touches.select("segment", F.col("frame").alias("at"), "view", "track"), ["segment"], "start", "at", 0, round(0.2 * fps)).where("track = owner")
    views = seen.groupBy("segment", "miss").agg(F.count_distinct("view").alias("views"))
    stable = F.col("end") - F.col("start") >= round(0.25 * fps)
    return first.join(views, ["segment", "miss"], "left").withColumn("confirmed", stable | (F.coalesce("views", F.lit(0)) >= 2)).withColumn("method", F.when(stable, "stable_control").when(F.col("confirmed"), "brief_multi_view").otherwise("unverified"))
