"""Readers, writers, settings and scalar functions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from framelake.functions import scalar as X
from framelake.sources import config, readers, sinks


def bundle(**over):
    pose = {"bbox": [10, 100, 60, 230], "keypoints_xy": [[30.0, 180.0]] * 9 + [[30.0, 160.0], [35.0, float("nan")]] + [[30.0, 180.0]] * 6, "keypoints_conf": [0.9] * 17, "detection_confidence": 0.8}
    base = {
        "schema_version": readers.VERSION,
        "video_info": {"a": {"path": "a.mp4", "width": 320, "height": 240, "fps": 30.0, "total_frames": 90, "frame_offset": -900}, "b": {"path": "b.mp4", "width": 320, "height": 240, "fps": 30.0, "total_frames": 90, "frame_offset": 0}},
        "poses_2d": {"900": {"1": {"a": pose}}, "902.0": {"1": {"a": pose, "b": pose}}},
        "ground_positions_3d": {"900": {"1": [2.0, 2.0, 0.0], "2": [float("nan"), 0.0, 0.0]}},
        "balls_2d": {"900": {"a": {"center_xy": [1.0, 2.0], "bbox": [0.0, 0.0, 8.0, 4.0], "confidence": 0.9}}},
        "balls_3d": {"900": [1.0, 2.0, 3.0], "901": None, "902": [1.0, 2.0, 4.0]},
        "balls_3d_predicted": {"902": True},
    }
    return base | over


def save(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value))
    return str(path)


def test_bundle(spark, tmp_path):
    b = readers.read_bundle(spark, save(tmp_path, "seg1.json", bundle()))
    assert readers.segments(b).first().asDict() == {"segment": "seg1", "fps": 30.0, "start": 900, "end": 903}
    assert {r["view"]: r["frame_zero"] for r in readers.views(b).collect()} == {"a": 900, "b": 0}
    assert readers.poses(b).count() == 3
    h = readers.hands(readers.poses(b)).where("frame = 900").first()
    assert h["height"] == 130 and [(w["x"], w["y"]) for w in h["wrists"]] == [(30.0, 160.0)]
    assert readers.balls(b).first()["radius"] == 3.0
    assert readers.ground(b).count() == 1
    assert [(r["frame"], r["z"], r["views"]) for r in readers.ball_positions(b).collect()] == [(900, 3.0, 2)]


@pytest.mark.parametrize("over, message", [({"schema_version": "1"}, "version"), ({"poses_2d": {}}, "without frames"), ({"video_info": {"a": {"fps": 30.0}, "b": {"fps": 25.0}}}, "frame rate")])
def test_bad_bundles(spark, tmp_path, over, message):
    path = save(tmp_path, "bad.json", bundle(**over))
    with pytest.raises(Exception, match=message):
        readers.read_bundle(spark, path).collect()


def test_evidence(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text("\n".join(json.dumps({"frame": f, "selection_note": n}) for f, n in ((1, "x"), (2, "y"), (1, "z"))))
    assert {(r["frame"], r["selection_note"]) for r in readers.read_evidence(spark, str(path)).collect()} == {(1, "z"), (2, "y")}
    frames = spark.createDataFrame([(0, 2)], "start int, end int")
    with pytest.raises(Exception, match="outside"):
        readers.read_evidence(spark, str(path), frames).collect()


def test_hoop_precedence(spark):
    one = spark.createDataFrame([("s", [1.0, 2.0, float("nan")]), ("t", [1.0, 1.0, 3.0])], "segment string, p array<double>")
    two = spark.createDataFrame([("s", [5.0, 5.0, 3.0]), ("u", None)], "segment string, p array<double>")
    got = {r["segment"]: (r["source"], r["p"]) for r in readers.hoop_centre([("own", one), ("found", two)], (0.0, 0.0, 3.05)).collect()}
    assert got == {"s": ("found", [5.0, 5.0, 3.0]), "t": ("own", [1.0, 1.0, 3.0]), "u": ("default", [0.0, 0.0, 3.05])}


def test_lists(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("v/a.mp4 3\nv/b.mp4 120 4\nv/c.mp4\n")
    got = {(r["path"], r["frames"], r["label"], r["clip"]) for r in readers.read_labelled_paths(spark, str(p), clips=2).collect()}
    assert got == {(f"v/{n}.mp4", f, x, c) for n, f, x in (("a", None, 3), ("b", 120, 4), ("c", None, 0)) for c in (0, 1)}
    rows = spark.range(10)
    assert [r[0] for r in readers.read_chunk(rows, "id", 7, 5).collect()] == [7, 8, 9] and [r[0] for r in readers.read_chunk(rows, "id", 12, 3).collect()] == [0, 1, 2]
    b = tmp_path / "b.csv"
    b.write_text("v,4,0,0,1,1,3,0.9\nv,4,0,0,1,1,5,0.9\nv,5,0,0,1,1,3,0.9\nw,8,0,0,1,1,2,0.2\n")
    boxes = readers.read_boxes(spark, str(b), least_score=0.5, every=4)
    assert [(r["video"], r["labels"]) for r in boxes.collect()] == [("v", [3, 5])]
    assert readers.drop_excluded(boxes, spark.createDataFrame([("v", 4)], "video string, sec int")).count() == 0
    m = tmp_path / "m.pbtxt"
    m.write_text('item {\n  name: "bend"\n  id: 1\n}\nitem {\n  name: "sit"\n  id: 11\n}\n')
    assert {(r["label"], r["name"]) for r in readers.read_label_map(spark, str(m)).collect()} == {(1, "bend"), (11, "sit")}
    splits = spark.createDataFrame([("a/b/c.mp4", "train", 0), ("a/b/c.mp4", "test", 1), ("d.mp4", "test", 2)], "path string, split string, order int")
    assert {(r["split"], r["moved"]) for r in readers.rewrite_paths(splits, "/r").collect()} == {("train", "/r/b/c.mp4"), ("test", "/r/d.mp4")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, float("nan")], {"k": float("inf")}, (float("nan"), 2))], "id int, v array<double>, m map<string,double>, s struct<a:double,b:int>")
    sinks.write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert "NaN" not in text and "Inf" not in text and json.loads(text)["v"] == [1.0, None]
    boxes = spark.createDataFrame([("v", 4, 0.0, 0.1, 0.25, 1.0, 3, 0.5)], "video string, sec int, x1 double, y1 double, x2 double, y2 double, label int, score double")
    assert sinks.box_lines(boxes).first()[0] == "v,0004,0.000,0.100,0.250,1.000,3,0.5000"
    assert "&lt;b&gt;" in sinks.report(spark.createDataFrame([("<b>",)], "x string"), "t")
    runs = spark.createDataFrame([("s", "pose", "failed", 1, "a"), ("s", "pose", "done", 2, "b")], "segment string, stage string, status string, at int, digest string")
    assert sinks.manifest(runs).first().asDict() == {"segment": "s", "stage": "pose", "status": "done", "digest": "b", "runs": 2}


def test_settings(tmp_path):
    a, b = save(tmp_path, "a.json", {"x": {"y": 1, "z": "${x.y}"}, "p": "at-${x.y}"}), save(tmp_path, "b.json", {"x": {"y": 2}})
    s = config.Settings.load(a, b, str(tmp_path / "none.json"))
    assert s.get("x.z") == 2 and s.get("p") == "at-2" and s.get("q.r", 5) == 5 and s.replaced("x.w", 3).get("x.w") == 3
    with pytest.raises(ValueError, match="unknown"):
        config.closed({"a": 1, "b": 2}, {"a"})
    with pytest.raises(ValueError, match="must be"):
        config.closed({"c": 2}, set(), {"c": 1})


def test_scalars(spark):
    c = {
        "code": X.timecode_frame(F.lit("00:01:02:03")), "bad": X.timecode_frame(F.lit("00:01:02")), "sec": X.timestamp_seconds(F.lit("01:00:02.5")),
        "key": X.image_key(F.lit("v"), F.lit(7)), "zone": X.shot_zone(F.lit(2.0), F.lit(2.0), [(0, 0), (4, 0), (4, 4), (0, 4)]),
        "edge": X.shot_zone(F.lit(4.1), F.lit(2.0), [(0, 0), (4, 0), (4, 4), (0, 4)]), "out": X.shot_zone(F.lit(9.0), F.lit(2.0), [(0, 0), (4, 0), (4, 4), (0, 4)]),
        "px": X.court_pixel(F.lit(7.5), F.lit(14.0))[0], "py": X.court_pixel(F.lit(7.5), F.lit(14.0))[1],
        "cats": X.categories(F.lit("made and block"), {"made": ["made"], "steal": ["steal"], "block": ["block", "swat"]}),
        "soft": X.softmax(F.array(F.lit(1.0), F.lit(1.0))), "ce": X.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1)), "hot": X.one_hot(F.lit(1), 2, 0.1),
        "bits": X.binary_vector(F.array(F.lit(0), F.lit(2)), 3), "rate": X.cosine_rate(F.lit(5.0), 1.0, 0.0, 10.0), "step": X.step_rate(F.lit(5.0), 1.0, [(0, 1.0), (4, 0.1)]),
        "fall": X.fall_roots(F.lit(2.0), F.lit(0.0), 0.0), "score": X.highlight_score(F.lit(True), F.lit(False), F.lit(True)), "face": X.face_cost(F.lit(0.65)),
        "src": X.checked_source_frame(F.lit(5), F.lit(9), F.lit(90)), "sq": X.square_box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(4.0))["x1"], "u": X.project([F.lit(1.0), F.lit(2.0), F.lit(4.0)], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]])[0],
    }
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (r["code"], r["bad"], r["sec"], r["key"]) == (62 * 30 + 3, None, 3602.5, "v,0007")
    assert (r["zone"], r["edge"], r["out"], r["px"], r["py"]) == ("inside_arc", "unknown", "outside_arc", 400, 700)
    assert r["cats"] == ["made", "block"] and r["soft"] == [0.5, 0.5] and abs(r["ce"] - math.log(2)) < 1e-12
    assert r["hot"] == pytest.approx([0.05, 0.95]) and r["bits"] == [1, 0, 1] and abs(r["rate"] - 0.5) < 1e-12 and abs(r["step"] - 0.1) < 1e-12
    assert abs(r["fall"] - math.sqrt(4 / 9.81)) < 1e-12 and r["score"] == 65 and abs(r["face"] - 0.5) < 1e-9 and r["src"] is None and r["sq"] == -1.0 and r["u"] == 0.25
    assert X.frames_of(0.25, 10) == 2 and X.frames_of(0.5, 7) == 4


def test_digest_with_sorted_keys(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from framelake.functions.scalar import digest

    schema = "row struct<b:int,a:struct<z:string,c:array<struct<y:int,x:int>>>,m:map<string,int>,n:string>"
    value = {"b": 1, "a": {"z": "é", "c": [{"y": 2, "x": None}]}, "m": {"q": 1, "p": 2}, "n": None}
    df = spark.createDataFrame([(value,)], schema)
    want = hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(digest(F.col("row"), df.schema["row"].dataType)).first()[0] == want
