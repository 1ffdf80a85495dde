"""Geometry of several views, camera choice and evaluation."""

import numpy as np

from framelake.operators import cameras as C
from framelake.operators import evaluation as E
from framelake.operators import ranking as R
from framelake.operators import sequences as S
from framelake.operators import space as P
from framelake.operators import statistics as T


def camera(angle):
    k = np.array([[800, 0, 500], [0, 800, 400], [0, 0, 1.0]])
    at = np.array([20 * np.cos(angle), 20 * np.sin(angle), 4.0])
    z = -at / np.linalg.norm(at)
    x = np.cross(z, [0, 0, 1.0])
    x /= np.linalg.norm(x)
    r = np.stack([x, np.cross(z, x), z])
    return k @ np.concatenate([r, (-r @ at)[:, None]], axis=1)


CAMS = {"a": camera(0.2), "b": camera(1.6), "c": camera(3.0)}


def test_triangulation_and_ground():
    p = np.array([1.0, -2.0, 1.5])
    seen = [P.reproject(p, c) for c in CAMS.values()]
    assert np.allclose(P.triangulate(seen, list(CAMS.values())), p)
    floor = np.array([2.0, 1.0, 0.0])
    assert np.allclose(P.ground_point(tuple(P.reproject(floor, CAMS["a"])), CAMS["a"]), floor[:2])
    o = np.array([[5.0, 0, 0], [0, 5.0, 0], [0, 0, 5.0]])
    assert np.allclose(P.ray_meeting(o, p - o), p)


def test_ball_consensus_ignores_wrong_candidates(spark):
    p = np.array([1.0, -2.0, 1.5])
    rows = []
    for v, c in CAMS.items():
        u = P.reproject(p, c)
        rows += [("s", 5, v, float(u[0]), float(u[1]), 0.5), ("s", 5, v, float(u[0] + 170), float(u[1] - 90), 0.9)]
    df = spark.createDataFrame([*rows, ("s", 6, "a", 1.0, 1.0, 0.9)], "segment string, frame long, view string, x double, y double, confidence double")
    (got,) = P.select_balls(df, {v: c.tolist() for v, c in CAMS.items()}).collect()
    assert got["views"] == 3 and np.allclose([got["x"], got["y"], got["z"]], p, atol=1e-6)


def test_tracks_chains_and_clusters(spark):
    boxes = spark.createDataFrame([("s", f, i, 100.0 * i + f, 0.0) for f in range(5) for i in (1, 4)] + [("s", 9, 1, 900.0, 0.0)], "segment string, frame long, det long, x double, y double")
    got = {(r["frame"], r["det"]): r["track"] for r in P.follow_centres(boxes).collect()}
    assert len({got[f, 1] for f in range(5)}) == 1 and got[9, 1] not in {got[0, 1], got[0, 4]}
    c = spark.createDataFrame([("s", f, 10.0 * f, 0.0, 0.5) for f in range(4)] + [("s", 2, 500.0, 0.0, 0.9)], "segment string, frame long, x double, y double, confidence double")
    assert sorted((r["frame"], r["x"]) for r in P.best_chains(c).collect()) == [(f, 10.0 * f) for f in range(4)]
    pts = spark.createDataFrame([("v", x, 1.0) for x in (0.0, 10.0, 20.0, 400.0)] + [("w", 5.0, 2.0), ("w", 7.0, 2.0)], "view string, x double, y double")
    assert {(r["view"], r["cluster"], r["x"]) for r in P.clusters(pts, ["view"]).collect()} == {("v", 0, 10.0), ("v", 1, 400.0), ("w", 0, 6.0)}
    hoop = spark.createDataFrame([("s", 1.0, 1.0, 3.0, 0.1), ("s", 1.2, 1.0, 3.0, 0.3), ("s", 9.0, 9.0, 3.0, 2.0)], "segment string, x double, y double, z double, distance double")
    (h,) = P.agree(hoop, ["segment"]).collect()
    assert h["n"] == 2 and not h["ambiguous"] and abs(h["x"] - 1.1) < 1e-9
    joints = spark.createDataFrame([("t", f, [[0.0, 0.0, 0.0], [0.4 if f % 2 else 0.6, 0.0, 0.0]], 5.0 if f < 30 else 99.0, False) for f in range(40)], "track string, frame long, joints array<array<double>>, error_px double, predicted boolean")
    (b,) = P.bone_lengths(joints, [(0, 1)]).collect()
    assert b["n"] == 30 and abs(b["length"] - 0.5) < 1e-9


def test_camera_choice(spark):
    rows = [("k", f, v, q) for f in range(0, 300, 6) for v, q in (("a", 0.9 if f < 150 else 0.3), ("b", 0.3 if f < 150 else 0.9))]
    schema = "clip string, frame long, view string, quality double"
    clips = spark.createDataFrame([("k", 0, 300)], "clip string, start long, end long")
    none = spark.createDataFrame([], "clip string, frame long")
    got = C.choose_shots(spark.createDataFrame(rows, schema), none, clips, 30).orderBy("start").collect()
    assert [(r["start"], r["end"], r["view"]) for r in got] == [(0, 150, "a"), (150, 300, "b")]
    near = spark.createDataFrame([("k", 150)], "clip string, frame long")
    got = C.choose_shots(spark.createDataFrame(rows, schema), near, clips, 30).orderBy("start").collect()
    assert len(got) == 2 and abs(got[0]["end"] - 150) >= 15
    flat = spark.createDataFrame([(c, f, v, q if v == "a" else q - 0.02) for c, f, v, q in rows if v == "a"] + [("k", f, "b", 0.5) for f in range(0, 300, 6)], schema)
    assert C.choose_shots(flat.withColumn("quality", flat["quality"] * 0 + 0.5), none, clips, 30).count() == 1


def test_box_quality(spark):
    boxes = spark.createDataFrame([("s", f, "v", "1", 10.0 + f, 10.0, 110.0 + f, 410.0, 1.0) for f in range(7)] + [("s", 3, "v", "2", 13.0, 10.0, 63.0, 410.0, 0.5)], "segment string, frame long, view string, track string, x1 double, y1 double, x2 double, y2 double, joints double")
    got = {(r["frame"], r["track"]): r["quality"] for r in C.box_quality(boxes, 1920, 1080).collect()}
    size = 400 / 432
    assert abs(got[3, "1"] - (0.35 * 0.5 + 0.25 * size + 0.2 + 0.15 + 0.05)) < 1e-9
    assert abs(got[0, "1"] - (0.35 + 0.25 * size + 0.2 + 0.05)) < 1e-9
    grid = spark.createDataFrame([("s", "k", 3, "v"), ("s", "k", 3, "w")], "segment string, clip string, frame long, view string")
    actors = spark.createDataFrame([("s", "k", "1")], "segment string, clip string, track string")
    balls = spark.createDataFrame([("s", 3, "w")], "segment string, frame long, view string")
    q = {r["view"]: r["quality"] for r in C.view_quality(grid, actors, C.box_quality(boxes, 1920, 1080), balls).collect()}
    assert abs(q["v"] - 0.8 * got[3, "1"]) < 1e-9 and abs(q["w"] - 0.2) < 1e-9


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "Shooting", 100, 110, ["7"]), (2, "Passing", 200, 190, ["7"]), (3, "Cheer", 1, 2, ["7"]), (4, "Shooting", 900, 910, ["8"]), (5, "Shooting", 300, 310, ["9"])], "truth_id int, category string, start long, end long, ids array<string>")
    found = spark.createDataFrame([(10, "shoot", 120, "7"), (11, "layup", 101, "7"), (12, "pass", 700, "7"), (13, "shoot", 890, "7"), (14, "layup", 320, "9")], "det_id int, type string, frame long, actor string")
    expected = E.expected_types(spark, {"Shooting": ["shoot", "layup"], "Passing": ["pass"]})
    m = E.match_within(truth, found, expected, 50)
    assert {r["truth_id"]: r["det_id"] for r in m.collect()} == {1: 10, 2: None, 3: None, 4: None, 5: 14}
    rows = {r["category"]: r.asDict() for r in E.by_category(m, ["Shooting", "Passing"]).collect()}
    assert (rows["Shooting"]["matched"], rows["Shooting"]["missed"], rows["Passing"]["bad"], rows["Cheer"]["incomparable"]) == (2, 1, 1, 1) and rows["Shooting"]["match_rate"] == 0.667
    assert {r["det_id"] for r in E.extras(found, truth, expected, 50).collect()} == {12}
    d = E.diagnose(m.where("truth_id = 4").drop("det_id", "off"), found, expected).collect()
    assert [(r["det_id"], r["reason"]) for r in d] == [(13, "other actor")]
    assert {(r["id"], r["actor"]) for r in E.id_map(truth, found, expected).collect()} == {("7", "7"), ("8", "7"), ("9", "9")}


def test_small_rules(spark):
    rows = spark.createDataFrame([("s", f, k) for f, k in enumerate("aabaaabbbb")], "segment string, frame long, state string")
    got = [r["state"] for r in S.majority(rows, ["segment"], "frame", "state", 2, 3).orderBy("frame").collect()]
    assert "".join(got) == "aaaaaabbbb"
    path = spark.createDataFrame([("s", f, float(min(f, 5)), float(max(f - 5, 0))) for f in range(11)], "segment string, frame long, x double, y double")
    turn = {r["frame"]: r["turn_cosine"] for r in S.turn_cosine(path, ["segment"], "frame", "x", "y", 3).collect()}
    assert abs(turn[5]) < 1e-9 and abs(turn[2] - 1) < 1e-9
    assert {r["frame"]: r["speed"] for r in S.speeds(path, ["segment"], "frame", "x", "y", 30).collect()}[4] == 30.0
    v = spark.createDataFrame([("t", [3.0, 0.0]), ("t", [0.0, 5.0]), ("t", [0.0, 0.0])], "track string, v array<double>")
    (u,) = T.mean_unit_vector(v, ["track"], "v").collect()
    assert np.allclose(u["unit"], [2**-0.5, 2**-0.5])
    s = spark.createDataFrame([("t", f, float(f % 7)) for f in range(0, 600, 10)], "track string, frame long, score double")
    kept = sorted(r["frame"] for r in T.spaced_sample(s, ["track"], "frame", 6, 120).collect())
    assert kept and all(b - a >= 120 for a, b in zip(kept, kept[1:], strict=False))
    votes = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.4)], "query int, label int, similarity double")
    assert R.weighted_vote(votes, "label", 0.1).orderBy("vote").collect()[-1]["label"] == 0
