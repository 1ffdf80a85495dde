"""Trajectory numerics, matching and online filters."""

import itertools

import numpy as np
import pandas as pd

from framelake.operators import flights as L
from framelake.operators import matching as M
from framelake.operators import trajectory as T
from framelake.streaming import stateful as S

FPS = 30


def throw(frames, p0=(0, 0, 2.0), v0=(3.0, 0, 6.0)):
    t = (np.array(frames) - frames[0]) / FPS
    return T.along(t, np.array(p0, float), np.array(v0, float))


def test_fit_recovers_a_throw():
    f = np.arange(20)
    p0, v0, rms = T.fit_flight(f / FPS, throw(f))
    assert np.allclose(p0, (0, 0, 2)) and np.allclose(v0, (3, 0, 6)) and rms < 1e-9
    assert abs(T.apex(p0, v0, 2.0) - (2 + 36 / (2 * 9.81))) < 1e-9


def test_outliers_are_found_and_good_points_stay():
    f = np.arange(30)
    p = throw(f, (0, 0, 1.0), (2.0, 0, 4.0))
    assert not T.outliers(f, p, np.full(30, 4), FPS).any()
    q = p.copy()
    q[10] += (0, 3.0, 0)
    assert T.outliers(f, q, np.full(30, 4), FPS)[10]
    q = p.copy()
    q[20, 2] = 12
    assert T.outliers(f, q, np.full(30, 4), FPS)[20]


def test_bounce_and_flights():
    down, up = throw(range(20), (0, 0, 2.0), (1, 0, 0)), throw(range(20), (0.66, 0, 0.12), (1, 0, 4.0))
    p = np.concatenate([down[down[:, 2] > 0.1], up])
    f = np.arange(len(p))
    (hit,) = L.bounces(f, p, FPS)
    assert abs(hit[0] - (down[:, 2] > 0.1).sum()) <= 1
    still = np.tile([5.0, 5, 1], (40, 1))
    path = np.concatenate([still, throw(range(30), (5, 5, 1), (2, 1, 7))])
    (found,) = L.flights(np.arange(70), path, np.zeros(70, bool), FPS)
    assert 30 <= found.start <= 42 and 60 <= found.end <= 69


def test_fill_uses_the_throw_and_leaves_long_holes():
    f = np.concatenate([np.arange(10), np.arange(18, 30), np.arange(80, 90)])
    full = throw(np.arange(90), (0, 0, 2), (1, 0, 8))
    grid, values, observed, filled = T.fill(f, full[f], np.zeros(len(f), bool), [], FPS)
    assert (grid == np.arange(90)).all() and (grid[observed] == f).all()
    assert np.allclose(values[10:18], full[10:18], atol=1e-6) and filled[10:18].all()
    assert np.isnan(values[30:80]).all() and not filled[30:80].any()


def test_smoother_follows_noise_free_data_and_is_zero_before_it():
    f = np.arange(60)
    p = throw(f, (0, 0, 2), (1, 0, 9))
    p[:5] = np.nan
    position, velocity = T.rts(f, p, FPS)
    assert np.allclose(position[20:], p[20:], atol=0.02) and (position[:5] == 0).all()
    assert np.allclose(velocity[30, 0], 1, atol=0.2)


def test_isolated_jump_is_put_back():
    p = np.array([(0, 0), (0.1, 0), (0.2, 0), (4, 4), (0.4, 0)], float)
    got = T.repair_jumps(np.arange(5), p, least=0.5, scale=3.0)
    assert np.allclose(got[3], (0.3, 0), atol=0.01)


def test_hungarian_matches_all_permutations():
    r = np.random.default_rng(5)
    for _ in range(60):
        n, m = int(r.integers(1, 5)), int(r.integers(1, 6))
        cost = r.random((n, m)).round(2)
        cost[r.random((n, m)) < 0.2] = np.inf
        pairs = M.hungarian(cost)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        best = (0, 0.0)
        small, large = (cost, m) if n <= m else (cost.T, n)
        for p in itertools.permutations(range(large), min(n, m)):
            c = [small[i, j] for i, j in enumerate(p) if np.isfinite(small[i, j])]
            best = max(best, (len(c), -sum(c)))
        assert len(pairs) == best[0] and abs(sum(cost[i, j] for i, j in pairs) + best[1]) < 1e-9


def test_grouped_forms(spark):
    f = np.arange(40)
    rows = [("s", int(i), *map(float, x), 4) for i, x in zip(f, throw(f, (0, 0, 1), (2, 1, 7)), strict=True) if not 12 <= i < 18]
    balls = spark.createDataFrame(rows, "segment string, frame long, x double, y double, z double, views long")
    assert T.flag_outliers(balls, FPS).where("outlier").count() == 0
    assert T.find_flights(balls, FPS).count() >= 1
    got = T.smooth(balls, FPS)
    assert got.count() == 40 and got.where("filled").count() == 6
    assert T.find_bounces(balls, FPS).count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [(k, f, None if f % 7 == 3 else 0.1 * f + k, 1.0, 9.0 if f == 20 else 2.0) for k in (1, 2) for f in range(40)]
    schema = "track long, frame long, x double, y double, z double"
    want = S.run_batch(spark.createDataFrame(rows, schema), ["track"], S.BallFilter).toPandas().sort_values(["track", "frame"]).reset_index(drop=True)
    assert want["predicted"].sum() > 8 and not want["x"].isna().all()
    for i, (lo, hi) in enumerate(((0, 15), (15, 28), (28, 40))):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _ = i
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = S.run_stream(stream, ["track"], S.BallFilter).writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("filtered").toPandas().sort_values(["track", "frame"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_other_filters(spark):
    rows = [(1, f, [float(f), 0.0, 0.0] if f % 3 else None) for f in range(12)]
    got = S.run_batch(spark.createDataFrame(rows, "track long, frame long, joints array<double>"), ["track"], S.JointSmoother).orderBy("frame").collect()
    assert got[0]["joints"] is None and got[3]["held"] and got[3]["joints"] == got[2]["joints"]
    rows = [("v", f, [10.0 * f, 500.0], [0.0, 500.0], [0.9, 0.8], [20.0, 20.0], [0.5, 0.5]) if f != 4 else ("v", f, None, None, None, None, None) for f in range(8)]
    got = S.run_batch(spark.createDataFrame(rows, "view string, frame long, xs array<double>, ys array<double>, scores array<double>, sizes array<double>, oranges array<double>"), ["view"], S.BallTracker).orderBy("frame").collect()
    assert got[4]["missed"] == 1 and abs(got[7]["x"] - 70) < 1e-9
    rows = [(1, f, "a" if f < 6 else "b") for f in range(12)]
    got = S.run_batch(spark.createDataFrame(rows, "segment long, frame long, owner string"), ["segment"], S.OwnerFilter).orderBy("frame").collect()
    assert got[1]["control"] is None and got[2]["control"] == "a" and got[7]["control"] == "a" and got[8]["control"] == "b"


def test_a_resting_ball_gives_way_to_a_better_one():
    tracker, rest = S.BallTracker(still=3), ([100.0], [100.0], [0.2], [20.0], [0.05])
    for _ in range(5):
        assert tracker.step(*rest)[:2] == (100.0, 100.0)
    both = ([100.0, 160.0], [100.0, 100.0], [0.2, 0.9], [20.0, 20.0], [0.05, 0.07])
    assert tracker.step(*both)[0] == 100.0  # too little orange
    assert tracker.step([100.0, 160.0], [100.0, 100.0], [0.2, 0.3], [20.0, 20.0], [0.05, 0.35]) == (160.0, 100.0, 0, True)
    # A far candidate of poor quality is no jump, one of good quality is.
    assert tracker.step([500.0], [100.0], [0.1], [1.0], [0.0])[2] == 1
    assert S.BallTracker(state=([160.0, 100.0], [200.0, 0.0], 0, 0)).step([500.0], [100.0], [0.9], [1.0], [0.0])[0] == 500.0
