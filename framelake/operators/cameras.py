"""Choice of camera for a clip: quality of a view in each frame, and at most one cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed weights: free of others, size, joints, steadiness, inside the picture; people against ball.
WEIGHTS = (0.35, 0.25, 0.2, 0.15, 0.05)
PEOPLE, BALL = 0.8, 0.2
#: Frames of a track that one window looks at.
STRETCH = 4096


def box_quality(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Quality of each box (segment, frame, view, track, x1, y1, x2, y2, joints) among the others of its picture.

    Overlap with others adds up and stops at 1. Steadiness looks three frames back and ahead.
    """
    key = ["segment", "frame", "view"]
    other = boxes.select(*key, F.col("track").alias("o_"), *[F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")])
    area = F.greatest((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), F.lit(1.0))
    both = F.greatest(F.least("x2", "ox2") - F.greatest("x1", "ox1"), F.lit(0.0)) * F.greatest(F.least("y2", "oy2") - F.greatest("y1", "oy1"), F.lit(0.0))
    covered = boxes.join(other, key).where("track <> o_").groupBy(*key, "track").agg(F.sum(both / area).alias("covered_"))
    # Frames that are three apart lie in one stretch, or in the copies of those next to its ends; a long track is many stretches.
    frame = F.col("frame").cast("long")
    w = Window.partitionBy("segment", "view", "track", "stretch_").orderBy(frame)
    ahead, back = w.rangeBetween(3, 3), w.rangeBetween(-3, -3)
    stretches = F.array_distinct(F.transform(F.array(frame - 3, frame, frame + 3), lambda f: F.floor(f / STRETCH)))
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = boxes.join(covered, [*key, "track"], "left").withColumns({"cx_": cx, "cy_": cy})
    rows = rows.withColumn("stretch_", F.explode(F.when(frame.isNotNull(), stretches).otherwise(F.array(F.lit(None).cast("long")))))
    rows = rows.withColumns({"ax": F.first("cx_").over(back), "ay": F.first("cy_").over(back), "bx": F.first("cx_").over(ahead), "by": F.first("cy_").over(ahead)})
    rows = rows.where(F.col("stretch_").eqNullSafe(F.floor(frame / STRETCH)))
    tall = F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0))
    jitter = F.sqrt(F.pow(F.col("bx") - 2 * F.col("cx_") + F.col("ax"), 2) + F.pow(F.col("by") - 2 * F.col("cy_") + F.col("ay"), 2)) / tall
    parts = (
        1 - F.least(F.coalesce("covered_", F.lit(0.0)), F.lit(1.0)),
        F.least((F.col("y2") - F.col("y1")) / (0.4 * height), F.lit(1.0)),
        F.coalesce("joints", F.lit(0.0)),
        F.coalesce(F.greatest(1 - 5 * jitter, F.lit(0.0)), F.lit(0.0)),
        F.when((F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= width) & (F.col("y2") <= height), 1.0).otherwise(0.0),
    )
    return rows.select(*key, "track", sum((w_ * p for w_, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0)).alias("quality"))


def view_quality(grid: DataFrame, actors: DataFrame, quality: DataFrame, balls: DataFrame) -> DataFrame:
    """Quality of each view (segment, clip, frame, view of ``grid``): mean over the clip's actors, 0 for one unseen, and the ball."""
    wanted = grid.join(actors.select("segment", "clip", "track"), ["segment", "clip"], "left")
    people = wanted.join(quality, ["segment", "frame", "view", "track"], "left").groupBy("segment", "clip", "frame", "view").agg(F.avg(F.when(F.col("track").isNotNull(), F.coalesce("quality", F.lit(0.0)))).alias("people"))
    seen = balls.select("segment", "frame", "view").distinct().withColumn("ball", F.lit(1.0))
    return people.join(seen, ["segment", "frame", "view"], "left").withColumn("quality", PEOPLE * F.coalesce("people", F.lit(0.0)) + BALL * F.coalesce("ball", F.lit(0.0)))


def choose_shots(samples: DataFrame, critical: DataFrame, clips: DataFrame, fps: float, gain: float = 0.08, lead: float = 0.06) -> DataFrame:
    """One or two shots (clip, start, end, view) for each clip.

    ``samples`` has clip, frame, view, quality; ``clips`` clip, start, end; ``critical`` clip, frame. A cut is tried
    every half second, two seconds from the ends and half a second from critical frames, and taken where both sides
    have another best view by ``lead`` and the whole gains more than ``gain``. Sums before each cut are running sums.
    """
    w = Window.partitionBy("clip", "view").orderBy("frame")
    sums = samples.withColumns({"before_": F.sum("quality").over(w) - F.col("quality"), "n_": F.row_number().over(w) - 1, "all_": F.sum("quality").over(Window.partitionBy("clip", "view")), "c_": F.count("*").over(Window.partitionBy("clip", "view"))})
    best = samples.groupBy("clip", "view").agg(F.avg("quality").alias("q")).groupBy("clip").agg(F.max_by(F.struct("view", "q"), F.struct("q", F.col("view"))).alias("whole"))
    least, step = round(2 * fps), max(1, round(0.5 * fps))
    tries = clips.where(F.col("end") - F.col("start") >= 2 * least).select("clip", "start", "end", F.explode(F.sequence(F.col("start") + least, F.col("end") - least, F.lit(step))).alias("cut"))
    blocked = tries.join(critical.select("clip", F.col("frame").alias("k_")), "clip").where(F.abs(F.col("cut") - F.col("k_")) < 0.5 * fps).select("clip", "cut").distinct()
    tries = tries.join(blocked, ["clip", "cut"], "left_anti")
    at = tries.join(sums.select("clip", "view", "frame", "before_", "n_", "all_", "c_"), "clip").where("frame >= cut").groupBy("clip", "start", "end", "cut", "view").agg(F.min_by(F.struct("before_", "n_", "all_", "c_"), "frame").alias("s"))
    sides = at.where("s.n_ > 0").select("clip", "start", "end", "cut", "view", (F.col("s.before_") / F.col("s.n_")).alias("l"), ((F.col("s.all_") - F.col("s.before_")) / (F.col("s.c_") - F.col("s.n_"))).alias("r"), (F.col("s.n_") / F.col("s.c_")).alias("share"))
    tops = sides.groupBy("clip", "start", "end", "cut", "share").agg(F.max_by(F.struct("view", "l", "r"), F.struct("l", "view")).alias("a"), F.max_by(F.struct("view", "l", "r"), F.struct("r", "view")).alias("b"))
    good = tops.where((F.col("a.view") != F.col("b.view")) & (F.col("a.l") - F.col("b.l") >= lead) & (F.col("b.r") - F.col("a.r") >= lead))
    good = good.join(best, "clip").withColumn("gain", F.col("a.l") * F.col("share") + F.col("b.r") * (1 - F.col("share")) - F.col("whole.q")).where(F.col("gain") > gain)
    cut = good.groupBy("clip").agg(F.max_by(F.struct("cut", F.col("a.view").alias("one"), F.col("b.view").alias("two")), F.struct("gain", -F.col("cut"))).alias("c"))
    plan = clips.join(best, "clip").join(cut, "clip", "left")
    single = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("whole.view").alias("view")))
    double = F.array(F.struct(F.col("start").alias("start"), F.col("c.cut").cast("long").alias("end"), F.col("c.one").alias("view")), F.struct(F.col("c.cut").cast("long").alias("start"), F.col("end").alias("end"), F.col("c.two").alias("view")))
    return plan.select("clip", F.inline(F.when(F.col("c").isNull(), single).otherwise(double)))
