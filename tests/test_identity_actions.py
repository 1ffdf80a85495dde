"""Identity over views, frames and segments."""

from framelake.operators import identity as P

LOOK = {"r": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "g": [0.0, 0.0, 1.0]}


def test_views_fuse_to_persons(spark):
    rows = [("s", 1, v, i, 2.0 * i + d, 0.0, LOOK[c]) for v, d in (("u", 0.0), ("v", 0.2), ("w", -0.2)) for i, c in enumerate("rb") if not (v == "w" and c == "b")]
    got = P.fuse_views(spark.createDataFrame(rows, "segment string, frame long, view string, det long, x double, y double, appearance array<double>")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["person"], set()).add((r["view"], r["det"]))
    assert sorted(map(sorted, groups.values())) == [[("u", 0), ("v", 0), ("w", 0)], [("u", 1), ("v", 1)]]


def test_roster_keeps_tracks_and_revives(spark):
    rows = []
    for f in range(200):
        rows.append(("s", f, 0, 0.05 * f, 0.0, LOOK["r"]))
        if not 40 <= f < 130:
            rows.append(("s", f, 1, 5.0 - 0.02 * f, 3.0 if f < 40 else 9.0, LOOK["b"]))
    got = P.track_people(spark.createDataFrame(rows, "segment string, frame long, det long, x double, y double, appearance array<double>"), most=2).collect()
    by = {(r["frame"], r["det"]): r for r in got}
    assert len({by[f, 0]["track"] for f in range(200)}) == 1
    assert by[10, 1]["track"] == by[150, 1]["track"] != by[10, 0]["track"] and by[130, 1]["revived"]


def test_faces_quality_and_links(spark):
    people = spark.createDataFrame([("s", 1, "v", 1, 0.0, 0.0, 100.0, 200.0), ("s", 1, "v", 2, 60.0, 0.0, 160.0, 200.0)], "segment string, frame long, view string, det long, x1 double, y1 double, x2 double, y2 double")
    faces = spark.createDataFrame([("s", 1, "v", 7, 55.0, 20.0), ("s", 1, "v", 8, 110.0, 25.0), ("s", 1, "v", 9, 50.0, 190.0)], "segment string, frame long, view string, face long, cx double, cy double")
    assert {(r["row"], r["col"]) for r in P.faces_to_people(faces, people).collect()} == {(7, 1), (8, 2)}
    looks = spark.createDataFrame([("s", "a", LOOK["r"])] * 8 + [("s", "b", LOOK["r"]), ("s", "b", LOOK["b"])], "segment string, track string, appearance array<double>")
    spans = spark.createDataFrame([("s", "a", 0, 10), ("s", "b", 0, 10)], "segment string, track string, start long, end long")
    assert {r["track"]: r["usable"] for r in P.track_quality(looks, spans).collect()} == {"a": True, "b": False}
    known = spark.createDataFrame([("P1", LOOK["r"]), ("P2", LOOK["b"])], "player string, unit array<double>")
    new = spark.createDataFrame([("t", "1", [0.99, 0.1, 0.0]), ("t", "2", [0.7, 0.7, 0.0]), ("t", "3", [0.98, 0.15, 0.0]), ("t", "4", [0.0, 1.0, 0.0])], "segment string, track string, unit array<double>")
    assert {(r["track"], r["player"]) for r in P.link_segments(known, new).collect()} == {("1", "P1"), ("4", "P2")}
