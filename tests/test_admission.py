"""Admission of detections and evidence of events."""

from pyspark.sql import functions as F

from framelake.operators import admission as A
from framelake.operators import evidence as E

FPS = 30


def test_admission(spark):
    boxes = spark.createDataFrame([(1, "ball", 0.5, 0.0, 0.0, 10.0, 10.0), (2, "ball", 0.1, 0.0, 0.0, 10.0, 10.0), (3, "player", 0.9, 0.0, 0.0, 20.0, 60.0), (4, "player", 0.9, 0.0, 0.0, 500.0, 20.0), (5, "dog", 0.9, 0.0, 0.0, 9.0, 9.0)], "det int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = A.admit(boxes, {"ball": 0.3, "player": 0.5}, {"ball": (50.0, 500.0)})
    assert {r["det"] for r in got.collect()} == {1, 3}
    assert {r["det"] for r in A.route(boxes, boxes, ["player"]).collect()} == {1, 2, 3, 4, 5}
    ids = spark.createDataFrame([(0, 1), (1, 2), (7, 3)], "class_id int, det int")
    assert {(r["label"], r["det"]) for r in A.relabel(ids, {0: "ball", 1: "player"}).collect()} == {("ball", 1), ("player", 2)}
    balls = spark.createDataFrame([("v", 1.0, 1.0), ("v", 9.0, 9.0), ("w", 1.0, 1.0)], "view string, x double, y double")
    zones = spark.createDataFrame([("v", 0.0, 0.0, 2.0)], "view string, cx double, cy double, r double")
    assert {(r["view"], r["x"]) for r in A.outside_zones(balls, zones).collect()} == {("v", 9.0), ("w", 1.0)}
    players = spark.createDataFrame([(1, i, 0.1 * i, 5.0 if i != 3 else 99.0, 5.0) for i in range(6)], "frame int, det int, score double, gx double, gy double")
    assert {r["det"] for r in A.top_in_court(players, ["frame"], 2).collect()} == {5, 4}


def test_human_evidence(spark):
    body = [[50.0, 10.0 + 10 * i] for i in range(17)]
    rows = [("yes", body, [0.9] * 17), ("unsure", body, [0.1] * 17), ("away", [[500.0, 500.0]] * 17, [0.9] * 17)]
    df = spark.createDataFrame(rows, "k string, p array<array<double>>, c array<double>")
    ok = A.is_human(F.col("p"), F.col("c"), F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(200.0))
    assert {r["k"] for r in df.where(ok).collect()} == {"yes"}
    assert spark.range(1).select(A.valid_ball(F.lit(1.0), F.lit(1.0), F.lit(-0.5)), A.valid_ball(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"))).first()[:] == (True, False)


def test_boxes_and_labels(spark):
    schema = "image int, det int, box struct<x1:double,y1:double,x2:double,y2:double>"
    boxes = spark.createDataFrame([(1, 1, (-5.0, -5.0, 5.0, 5.0)), (1, 2, (50.0, 50.0, 60.0, 60.0)), (1, 3, (3.0, 3.0, 3.0, 9.0))], schema)
    assert {r["det"]: r["box"]["x1"] for r in A.clip_to_window(boxes, (0.0, 0.0, 10.0, 10.0)).collect()} == {1: 0.0}
    assert {r["det"] for r in A.drop_invalid(boxes).collect()} == {1, 2}
    other = spark.createDataFrame([(1, 9, (0.0, 0.0, 5.0, 5.0))], schema)
    assert {r["det"] for r in A.overlapping(A.drop_invalid(boxes), other, ["image"], 0.2).collect()} == {1}
    assert A.scale_boxes(boxes, 2.0, 1.0).first()["box"]["x1"] == -10.0
    preds = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 1), (2, 0)], "truth int, predicted int")
    assert A.wrong_predictions(preds, [2]).count() == 1
    assert {(r["truth"], tuple(r["taken_for"])) for r in A.confused_with(preds).collect()} == {(0, (1, 2)), (2, (0,))}
    rows = spark.createDataFrame([("v", [1]), ("v", [2, 1]), ("w", [3])], "video string, labels array<int>")
    assert {tuple(r["video_labels"]) for r in A.label_union(rows, "video", "labels").where("video = 'v'").collect()} == {(1, 2)}
    assert {r["origin"] for r in A.merge_tagged(boxes, other).collect()} == {"predicted", "truth"}
    m = spark.createDataFrame([(i, j, 1.0 + i * j) for i in range(3) for j in range(3)], "row int, col int, value double")
    assert all(abs(r["s"] - 1) < 1e-9 for r in A.balance(m).groupBy("row").agg(F.sum("value").alias("s")).collect())
    ck = spark.createDataFrame([(c, "w", 0, float(c)) for c in range(5)], "checkpoint int, name string, i int, value double")
    assert A.average_parameters(ck, 1, 3).first()["value"] == 2.0
    assert A.every_fourth_second(spark.createDataFrame([(s,) for s in range(9)], "sec int")).count() == 3


def test_opposed(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "r"), (None, "b"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(E.opposed(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_deflection_steal_and_block(spark):
    path = [("s", v, f, 10.0 * min(f, 20), 10.0 * max(f - 20, 0)) for v in "uv" for f in range(10, 40)]
    turns = E.deflections(spark.createDataFrame(path, "segment string, view string, frame long, x double, y double"))
    assert {(r["view"], r["frame"]) for r in turns.collect()} >= {("u", 20), ("v", 20)} and turns.where("abs(frame - 20) > 5").count() == 0
    pairs = spark.createDataFrame([("s", "1", "2", 20, 22, 40, "r", "b"), ("s", "1", "3", 20, 22, 25, "r", None)], "segment string, owner string, next_owner string, end long, next_start long, next_end long, team string, next_team string")
    touches = spark.createDataFrame([("s", 19, v, "2", "b") for v in "uv"], "segment string, frame long, view string, track string, team string")
    got = {r["next_owner"]: r for r in E.steals(pairs, touches, turns, FPS).collect()}
    assert got["2"]["confirmed"] and got["2"]["views"] == 2
    assert not got["3"]["confirmed"] and {"TEAM_RELATION_UNKNOWN", "CONTROL_TOO_BRIEF", "CONTACT_UNVERIFIED"} <= set(got["3"]["reasons"])
    touches = spark.createDataFrame([("s", 20, v, "2", "b") for v in "uv"], "segment string, frame long, view string, track string, team string")
    shots = spark.createDataFrame([("s", "x", 18, "1", "r", "missed"), ("s", "y", 18, "1", "b", "missed"), ("s", "z", 18, "1", "r", "made")], "segment string, event_id string, anchor long, shooter string, team string, outcome string")
    assert {r["event_id"]: r["status"] for r in E.blocks(shots, touches, turns, FPS).collect()} == {"x": "confirmed", "y": "uncertain", "z": "rejected"}


def test_drives_and_acquisitions(spark):
    rows = [("s", f, "1", 0.0, 4 - 2 * f / 60, "r") for f in range(70)] + [("s", f, "2", 0.2, 3.0, "b") for f in range(70)]
    schema = "segment string, frame long, track string, x double, y double, team string"
    controls = spark.createDataFrame([("s", "1", 0, 60)], "segment string, owner string, start long, end long")
    (d,) = E.drives(controls, spark.createDataFrame(rows, schema), (0.0, 0.0), FPS).collect()
    assert d["defender"] == "2" and d["advance"] >= 0.9
    same = [(*r[:5], "r") for r in rows]
    assert E.drives(controls, spark.createDataFrame(same, schema), (0.0, 0.0), FPS).count() == 0
    unknown = [(*r[:5], None if r[2] == "2" else "r") for r in rows]
    assert E.drives(controls, spark.createDataFrame(unknown, schema), (0.0, 0.0), FPS).count() == 0
    options = spark.createDataFrame([("s", "m", "4", 100, 103), ("s", "m", "5", 150, 190), ("s", "n", "6", 10, 40)], "segment string, miss string, owner string, start long, end long")
    touches = spark.createDataFrame([("s", 101, v, "4") for v in "uv"], "segment string, frame long, view string, track string")
    got = {r["miss"]: (r["owner"], r["method"]) for r in E.acquisitions(options, touches, FPS).collect()}
    assert got == {"m": ("4", "brief_multi_view"), "n": ("6", "stable_control")}
