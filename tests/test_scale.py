"""Work that has to grow with the input only: dense inputs within a time that a quadratic way would exceed by far."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_flights import plain_flights, track

from framelake.operators import cameras as C
from framelake.operators import evaluation as V
from framelake.operators import evidence as B
from framelake.operators import flights as L
from framelake.operators import masks as M
from framelake.operators import ranking as R
from framelake.operators import space as P
from framelake.operators import trajectory as J
from framelake.operators.sequences import median_smooth
from framelake.plans import ledger, registry, tracks, views, vision
from framelake.streaming import stateful

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def within():
    """Fails a test that takes longer than so many seconds."""
    begun = time.monotonic()

    def check(seconds):
        assert time.monotonic() - begun < seconds

    return check


def test_many_findings_at_few_times_are_compared(spark, within):
    n = 40_000
    at = "cast(id * 7 % 50 as long) as at"
    old = spark.range(n).selectExpr("'g' as group", "id as before", at)
    new = spark.range(n - 5).selectExpr("'g' as group", "id as after", at)
    got = V.compare_runs(old, new, ["group"], 30).groupBy("status", "distance").count().collect()
    assert sum(r["count"] for r in got if r["status"] == "matched") == n - 5
    assert {(r["status"], r["count"]) for r in got if r["status"] != "matched"} == {("lost", 5)}
    within(60)


def test_boxes_that_never_meet_are_followed(spark, within):
    boxes = spark.range(40_000).selectExpr("'s' as segment", "id div 2 as frame", "id % 2 as det", "cast(id * 1000 as double) as x", "0.0D as y")
    got = P.follow_centres(boxes).groupBy().agg({"track": "max", "*": "count"}).collect()[0]
    assert tuple(got) == (39_999, 40_000) or tuple(got) == (40_000, 39_999)
    within(25)


def test_annotations_meet_detections_of_their_own_ids_only(spark, within):
    n = 12_000
    truth = spark.range(n).selectExpr("id as truth_id", "'look' as category", "id % 100 as start", "array(cast(id as string), cast(id as string)) as ids")
    found = spark.range(n).selectExpr("id as det_id", "'view' as type", "id % 100 + 1 as frame", "cast(id as string) as actor")
    expected = V.expected_types(spark, {"look": ["view"]})
    got = V.match_within(truth, found, expected, 500)
    assert got.where("det_id = truth_id and off = 1").count() == n
    # Without ids, one detection for each frame in reach is met.
    assert V.match_within(truth, found, expected, 500, actors=False).where("off = 0").count() == n - n // 100
    within(30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_by_frame_are_not_broadcast(spark):
    names = ("fps", "x0", "y0", "z0", "vx0", "vy0", "vz0", "rms")
    found = spark.range(100).selectExpr("id as segment", "id * 10 as start", "id * 10 + 20 as end", *[f"1.0D as {c}" for c in names], "5 as points")
    places = spark.range(100).selectExpr("id as segment", "id * 10 as frame", "1.0D as x", "1.0D as y", "1.0D as z")
    named = L.name_flights(found, places.select("segment", "frame"), places)
    assert "BroadcastExchange" not in plan(named) and named.where("n_bounces = 1 and hand_distance = 0").count() == 100


def test_many_shots_of_one_player_meet_each_contact_once(spark, monkeypatch):
    pairs = []
    near = B.matching.within
    monkeypatch.setattr(B.matching, "within", lambda *a: pairs.append(near(*a)) or pairs[-1])
    shots = spark.range(60_000).selectExpr("'s' as segment", "id as event_id", "100L as anchor", "'p1' as shooter", "0 as team", "cast(null as string) as outcome")
    touches = spark.range(24 * 9 * 2).selectExpr("'s' as segment", "100 + id % 24 as frame", "if(id % 2 = 0, 'a', 'b') as view", "concat('q', id div 48) as track", "1 as team")
    got = B.blocks(shots, touches, touches.select("segment", "view", "frame"), 30.0)
    assert got.where("status is not null").count() == 60_000
    # Two frames and three players make six kinds of shots, nine players touch the ball in 24 frames.
    assert pairs[0].count() <= 6 * 9 * 24


def test_quality_of_long_tracks(spark):
    side = "cast(case when id between 4094 and 4097 then 3 * id else 2 * id end as double)"
    boxes = spark.range(4080, 4110).selectExpr("'s' as segment", "id as frame", "'v' as view", "'1' as track", f"{side} as x1", "1.0D as y1", f"{side} + 10 as x2", "11.0D as y2", "1.0D as joints")
    df = C.box_quality(boxes, 1e9, 1e9)
    got = {r["frame"]: r["quality"] for r in df.collect()}
    x = {f: 3 * f if 4094 <= f <= 4097 else 2 * f for f in range(4080, 4110)}
    for f in range(4080, 4110):
        jitter = abs(x[f + 3] - 2 * x[f] + x[f - 3]) / 10 if f - 3 in x and f + 3 in x else 9.0
        assert abs(got[f] - (0.35 + 0.25 * 10 / (0.4 * 1e9) + 0.2 + 0.15 * max(1 - 5 * jitter, 0) + 0.05)) < 1e-9
    assert len(got) == 30 and re.search(r"windowspecdefinition\([^)]*stretch_#", plan(df))


def test_lines_of_masks_are_never_shuffled(spark):
    masks = spark.range(200).selectExpr("id div 4 as image", "id % 4 as det", "if(id % 3 = 0, 'a', 'b') as label", "cast(id * 37 % 101 as double) as score", "transform(sequence(id % 3, 9L), y -> struct(y as y, id % 4 as x0, 6L + y % 2 as x1)) as runs").repartition("image")
    met = M.overlaps(masks, masks, ["image"], F.col("det") < F.col("o_det"))
    kept = M.suppress_classes(masks, None, ["image"], "label", 0.3, -1.0)
    # The runs of packed masks leave no exchange but that by image, which they came with.
    for df in (met, kept):
        assert not re.search(r"Exchange hashpartitioning\((?!image#\d+L?, \d+\)|image#\d+L?, det)[^)]*\)", plan(df))
    lines = masks.select("image", "det", F.inline("runs"))
    want = {tuple(r) for r in M.overlaps(lines, lines, ["image"]).where("det < o_det").select("image", "det", "o_det", "common").collect()}
    assert {tuple(r) for r in met.select("image", "det", "o_det", "common").collect()} == want and len(want) == 300
    apart = M.suppress_classes(lines, masks.drop("runs"), ["image"], "label", 0.3, -1.0)
    columns = ["image", "label", "det", "score", "rank"]
    assert sorted(map(tuple, kept.select(columns).collect())) == sorted(map(tuple, apart.select(columns).collect()))


def test_kernels_of_trajectories_cost_little_a_point():
    rng = np.random.default_rng(5)
    f = np.arange(6000)
    t = f % 50 / 30
    p = np.stack([t * 3, t, 1.5 + 5 * t - 4.905 * t * t], axis=1) + rng.normal(0, 0.08, (6000, 3))
    begun = time.process_time()
    good = L.on_throws(f, p, 30.0, L.Settings())
    place, speed = J.rts(f, p, 30.0)
    assert time.process_time() - begun < 1e-4 * len(f) and good.shape == (6000,)
    assert np.isfinite(place).all() and np.isfinite(speed).all()


def test_points_of_throws_are_not_shuffled(spark):
    # Only the throws are dealt, before each becomes fifty points; bounces then take one pass over whole segments.
    text = plan(tracks.thrown_bounces(spark, DATA))
    assert text.count("Exchange") == 1 and "FlatMapGroups" not in text


@pytest.mark.parametrize("points", [1, 50, 1 << 16])
def test_segments_judged_together_are_as_each_alone(spark, monkeypatch, points):
    monkeypatch.setattr(J, "POINTS", points)
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for segment in range(60):
        n = int(rng.integers(1, 70))
        f = np.cumsum(rng.integers(1, 4, n))
        p = np.cumsum(rng.normal(0, 0.3, (n, 3)), axis=0) + [0, 0, 1]
        p[rng.random(n) < 0.1] += 3
        p[:, 2] = np.where(rng.random(n) < 0.3, 0.1, np.abs(p[:, 2]))
        views = rng.integers(1, 5, n)
        bad = J.outliers(f, p, views, 30.0)
        want |= {(segment, at, round(strength, 9)) for at, strength in L.bounces(f[~bad], p[~bad], 30.0)}
        rows += [(segment, *r) for r in zip(f.tolist(), *p.T.tolist(), views.tolist(), strict=True)]
    balls = spark.createDataFrame(rows, "segment long, frame long, x double, y double, z double, views long")
    for found in (J.find_bounces(balls, 30.0, flag=True), J.find_bounces(J.flag_outliers(balls, 30.0), 30.0)):
        got = [(r["segment"], r["frame"], round(r["strength"], 9)) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 40


def test_flights_take_one_pass_over_whole_segments(spark):
    text = plan(tracks.trajectory_flights(spark, DATA))
    assert text.count("Exchange") == 1 and "FlatMapGroups" not in text and text.count("MapInArrow") == 1


@pytest.mark.parametrize("points", [1, 1 << 16])
def test_flights_of_many_segments_are_those_of_each(spark, monkeypatch, points):
    monkeypatch.setattr(J, "POINTS", points)
    rows, want = [], {}
    for segment in range(12):
        # Few points, some without a sound one, and frames that begin anywhere.
        f, p = track(segment)
        f, p = (f[: 3 * segment] if segment % 4 == 1 else f) + 10**9 * (segment % 3), p[: 3 * segment] if segment % 4 == 1 else p
        bad = np.random.default_rng(segment).random(len(f)) < (1.0 if segment == 6 else 0.05)
        want[segment] = plain_flights(f, p, bad)
        rows += [(segment, *r) for r in zip(f.tolist(), *p.T.tolist(), bad.tolist(), strict=True)]
    balls = spark.createDataFrame(rows, "segment long, frame long, x double, y double, z double, outlier boolean")
    got = {segment: [] for segment in want}
    for r in J.find_flights(balls, 30.0).orderBy("segment", "place").collect():
        assert r["place"] == len(got[r["segment"]])
        got[r["segment"]].append((r["start"], r["end"], r["points"]))
    assert got == want and sum(map(len, want.values())) > 20


def test_filling_takes_one_pass_over_whole_segments(spark):
    text = plan(tracks.filled_trajectory(spark, DATA))
    assert text.count("Exchange") == 1 and "FlatMapCoGroups" not in text and text.count("MapInArrow") == 1


@pytest.mark.parametrize("abreast", [1, 1 << 17])
def test_segments_filled_and_smoothed_together_are_as_each_alone(spark, monkeypatch, abreast):
    monkeypatch.setattr(J, "CELLS", abreast)
    rows, want, filled = [], {}, 0
    for segment in range(14):
        f, p = track(segment)
        f += 1000 * segment
        bad = np.random.default_rng(segment).random(len(f)) < (1.0 if segment == 6 else 0.05)
        grid, q, observed, own = J.fill(f, p, bad, L.flights(f, p, bad, 30.0), 30.0)
        flying = np.zeros(len(grid), bool)
        for k in L.flights(f, p, bad, 30.0):
            flying[k.start - grid[0] : k.end + 1 - grid[0]] = True
        hit = np.isin(grid, [x for x, _ in L.bounces(f[~bad], p[~bad], 30.0)])
        place, speed = J.rts(grid, np.where(observed[:, None], q, np.nan), 30.0, flying=flying, hit=hit)
        want[segment] = np.column_stack([grid, np.where(observed[:, None], place, q), place, speed, own, observed, np.isin(grid, f[bad]), hit])
        filled += own.sum()
        rows += [(segment, *r) for r in zip(f.tolist(), *p.T.tolist(), bad.tolist(), strict=True)]
    got = J.smooth(spark.createDataFrame(rows, "segment long, frame long, x double, y double, z double, outlier boolean"), 30.0).toPandas()
    columns = ["frame", *"xyz", "sx", "sy", "sz", "vx", "vy", "vz", "filled", "observed", "outlier", "bounce"]
    for segment, g in got.sort_values(["segment", "frame"]).groupby("segment"):
        np.testing.assert_allclose(g[columns].to_numpy(float), want[segment].astype(float), atol=1e-9)
    assert got["segment"].nunique() == 14 and filled > 30


def test_positions_of_events_are_smoothed_in_one_pass(spark):
    text = plan(ledger.smoothed_trajectory(spark, DATA))
    assert text.count("MapInArrow") == 1 and "FlatMap" not in text


def test_reconstruction_takes_one_pass_without_joins(spark):
    text = plan(tracks.reconstructed_ball(spark, DATA))
    # Windows: the throws of a customer, twice, and the order of a segment's rows.
    assert text.count("MapInArrow") == 1 and "Join" not in text and "FlatMap" not in text and text.count("Window [") == 3


def test_reconstruction_is_that_of_its_steps(spark):
    rows, hands = [], [(99, 5, 0.0, 0.0, 1.0)]
    for segment in range(14):
        f, p = track(segment) if segment < 13 else (np.arange(60), np.full((60, 3), 1.0))
        # Hands near the ball, two in some frames, some before the first point; one segment without any, one without a sound point.
        hands += [(segment, int(x) - 3 * (segment % 2), *(p[i] + 0.1 * (i % 7 if segment < 13 else 1)).tolist()) for i, x in enumerate(f) for _ in range(1 + i % 2) if segment != 3 and i % 40 < 25]
        rows += [(segment, int(x), *p[i].tolist(), 50.0 if segment == 6 else 0.0, 3) for i, x in enumerate(f)]
    balls = spark.createDataFrame(rows, "segment long, frame long, x double, y double, z double, up double, views long").withColumn("z", F.col("z") + F.col("up")).drop("up")
    hands = spark.createDataFrame(hands, "segment long, frame long, x double, y double, z double")
    flagged = J.flag_outliers(balls, 30.0)
    found = L.name_flights(J.find_flights(flagged, 30.0), J.find_bounces(flagged, 30.0), hands, 0.1)
    steps = J.smooth(flagged, 30.0, found).join(J.frames_of_flights(found), ["segment", "frame"], "left")
    want = median_smooth(J.ball_states(steps, hands), ["segment"], "frame", ["sx", "sy", "sz"], 13).toPandas().sort_values(["segment", "frame"])
    got = J.reconstruct(balls, hands, 30.0).toPandas().sort_values(["segment", "frame"])
    assert got[["segment", "frame"]].to_numpy().tolist() == want[["segment", "frame"]].to_numpy().tolist() and got["segment"].nunique() == 14
    known = (got["state"] != "unknown").to_numpy()
    assert got["state"][known].tolist() == want["state"][known].tolist() and {"flight", "dribble", "held"} <= set(got["state"])
    assert set(want["state"][~known & got["x"].notna().to_numpy()]) == {"unknown"}
    assert np.allclose(got["state_confidence"][known].astype(float), want["state_confidence"][known].astype(float))
    seen = got["observed"].to_numpy()
    assert np.allclose(got[["x", "y", "z"]][seen].astype(float), want[["sx", "sy", "sz"]][seen].astype(float)) and seen.sum() > 500


def test_buckets_of_the_score_grow_in_number_with_the_rows(spark, monkeypatch):
    scored = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as label", "id", "cast(id * 37 % 1009 as double) as score", "cast(id % 7 < 3 as int) as hit")
    positives = scored.groupBy("label").agg(F.sum("hit").alias("n_positive"))
    few = R.precision_recall(scored, ["label"], positives, "id")
    want = {(r["label"], r["id"], r["tp"], r["n"]) for r in few.collect()}
    area = sorted((r["label"], round(r["ap"], 12)) for r in R.average_precision(few, ["label"], "id").collect())
    monkeypatch.setattr(R, "BUCKET_ROWS", 10)
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    curve = R.precision_recall(scored, ["label"], positives, "id")
    assert {(r["label"], r["id"], r["tp"], r["n"]) for r in curve.collect()} == want and len(want) == 3000
    assert sorted((r["label"], round(r["ap"], 12)) for r in R.average_precision(curve, ["label"], "id").collect()) == area
    sizes = curve.groupBy("label", "bucket").count().groupBy().agg({"count": "max", "bucket": "max"}).collect()[0]
    assert sizes["max(count)"] < 60 and sizes["max(bucket)"] > 250
    assert re.search(r"Exchange hashpartitioning\(label#\d+, bucket#\d+, 30\)", plan(curve))


def test_boxes_are_matched_once_for_both_curves(spark, monkeypatch):
    matched = []
    match = R.match_boxes
    monkeypatch.setattr(R, "match_boxes", lambda *a: matched.append(1) or match(*a))
    classes, means = vision._evaluated(spark, DATA)
    assert len(matched) == 1 and not any("lineitem" in f for df in (classes, means) for f in df.inputFiles())


def test_boxes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(views, "BOXES", 500)
    assert re.search(r"Exchange hashpartitioning\(image#\d+L, 12\)", plan(registry.box_matching(spark, DATA)))


def test_a_frame_of_the_ball_tracker_costs_little():
    rng = np.random.default_rng(3)
    frames = [[rng.uniform(0, 400, 4).tolist() for _ in range(2)] + [rng.random(4).tolist(), rng.uniform(5, 99, 4).tolist(), rng.random(4).tolist()] for _ in range(20_000)]
    tracker = stateful.BallTracker()
    begun = time.process_time()
    for frame in frames:
        tracker.step(*frame)
    # Arrays of four numbers each took about 50 microseconds a frame and more.
    assert time.process_time() - begun < 2.5e-5 * len(frames)
