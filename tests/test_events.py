"""Event operators on small segments."""

import pytest

from framelake.operators import events as E

FPS = 30


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rules_are_positive():
    with pytest.raises(ValueError, match="hand_distance"):
        E.Rules(hand_distance=0)


def test_ownership_needs_frames_and_survives_short_gaps():
    machine, out = E.Ownership(3, 9), []
    owners = ["a"] * 5 + [None] * 8 + ["a"] + ["b"] * 2 + ["a"] + [None] * 12 + ["b"] * 3
    for f, o in enumerate(owners):
        out += machine.step(f, o)
    out.append(machine.close())
    assert out == [("a", 0, 17), ("b", 29, 32)]


def test_control_spans(spark):
    frames = frame(spark, [("s", f) for f in range(40)], "segment string, frame long")
    owners = frame(spark, [("s", f, "a") for f in range(10)] + [("s", f, "b") for f in range(12, 30)], "segment string, frame long, owner string")
    got = {tuple(r) for r in E.control_spans(frames, owners, FPS).collect()}
    assert got == {("s", "a", 0, 10), ("s", "b", 12, 30)}


def test_contested_ball_has_no_owner(spark):
    d = frame(spark, [("s", 1, "a", 0.05), ("s", 1, "b", 0.07), ("s", 2, "a", 0.05), ("s", 2, "b", 0.09), ("s", 3, "c", 0.1)], "segment string, frame long, track string, distance double")
    assert {(r["frame"], r["owner"]) for r in E.frame_owners(d).collect()} == {(2, "a"), (3, "c")}


def test_hand_distances_are_medians_over_views(spark):
    hands = frame(spark, [("s", 1, v, "a", 100.0, [(0.0, 0.0, 0.9), (500.0, 0.0, 0.1)]) for v in "uvw"], "segment string, frame long, view string, track string, height double, wrists array<struct<x:double,y:double,confidence:double>>")
    balls = frame(spark, [("s", 1, "u", 3.0, 4.0), ("s", 1, "v", 6.0, 8.0), ("s", 1, "w", 60.0, 80.0)], "segment string, frame long, view string, x double, y double")
    (got,) = E.hand_distances(hands, balls).collect()
    assert (got["distance"], got["views"]) == (0.1, 3)


def test_sidecar_fills_missing_views_only(spark):
    schema = "segment string, frame long, view string, x double, y double, confidence double"
    one = frame(spark, [("s", 1, "u", 1.0, 1.0, 0.1), ("s", 1, "v", 2.0, 2.0, 0.9)], schema)
    two = frame(spark, [("s", 1, "u", 9.0, 9.0, 0.9), ("s", 2, "u", 3.0, 3.0, 0.5), ("s", 3, "u", float("nan"), 3.0, 0.5)], schema)
    assert {(r["frame"], r["view"], r["x"]) for r in E.overlay(one, two, 0.16).collect()} == {(1, "v", 2.0), (2, "u", 3.0)}


def test_dribble_controls_merge(spark):
    c = frame(spark, [("s", "1", 0, 8), ("s", "1", 16, 26), ("s", "2", 27, 35)], "segment string, owner string, start long, end long")
    assert sorted(map(tuple, E.merge_controls(c, FPS).collect())) == [("s", "1", 0, 26), ("s", "2", 27, 35)]
    (t,) = E.transfers(c, -6, 36).collect()
    assert (t["owner"], t["next_owner"], t["gap"]) == ("1", "2", 1)


@pytest.mark.parametrize(
    "samples, want",
    [
        ([(f, 100, 140 - 5 * f, 4) for f in range(20)], []),
        ([(f, 100, y, 4) for f, y in enumerate((80, 90, 98, 101, 95, 85, 70))], []),
        ([(0, 100, 75, 8), (1, 102, 95, 8), (2, 117, 102, 8), (3, 145, 119, 8)], ["not inside"]),
        ([(f, 100, y, 8) for f, y in enumerate([75, *[95] * 17, 103, 115, 130])], ["inside"]),
    ],
)
def test_passages_through_the_rim(spark, samples, want):
    rows = frame(spark, [("s", "v", f, float(x), float(y), float(r)) for f, x, y, r in samples], "segment string, view string, frame long, x double, y double, radius double")
    rim = frame(spark, [("s", "v", 100.0, 100.0, 60.0, 8.0)], "segment string, view string, cx double, cy double, width double, height double")
    got = [r["result"] for r in E.passages(rows, rim, FPS).collect()]
    assert len(got) == len(want)
    assert all((g == "inside") == (w == "inside") for g, w in zip(got, want, strict=True))


def test_observed_path_from_hand_to_hand(spark):
    hands_schema = "segment string, frame long, view string, track string, height double, wrists array<struct<x:double,y:double,confidence:double>>"
    balls = frame(spark, [("s", f, "v", 10.0 * f, 0.0) for f in range(10, 21)], "segment string, frame long, view string, x double, y double")
    hands = frame(spark, [("s", f, "v", t, 100.0, [(x, 0.0, 0.9)]) for f in range(0, 40) for t, x in (("a", 100.0), ("b", 200.0))], hands_schema)
    pairs = frame(spark, [("s", "a", "b", 12, 19)], "segment string, owner string, next_owner string, end long, next_start long")
    (got,) = E.observed_paths(pairs, balls, hands, ["u", "v"], FPS).collect()
    assert (got["view"], got["first"], got["last"], got["n"]) == ("v", 10, 20, 11)
    swapped = frame(spark, [("s", "b", "a", 12, 19)], "segment string, owner string, next_owner string, end long, next_start long")
    assert E.observed_paths(swapped, balls, hands, ["u", "v"], FPS).collect() == []


def test_possession_ids_and_spans(spark):
    c = frame(spark, [("s", "1", 0, 10, "red"), ("s", "2", 15, 25, "red"), ("s", "3", 30, 40, "blue"), ("s", "4", 45, 60, None)], "segment string, owner string, start long, end long, team string")
    makes = frame(spark, [("s", 12)], "segment string, anchor long")
    ids = E.possession_ids(c, makes.limit(0), FPS)
    assert [r["possession"] for r in ids.orderBy("start").collect()] == [1, 1, 2, 3]
    assert [r["possession"] for r in E.possession_ids(c, makes, FPS).orderBy("start").collect()] == [1, 2, 3, 4]
    frames = frame(spark, [("s", f) for f in range(70)], "segment string, frame long")
    balls = frame(spark, [("s", f) for f in range(70) if not 40 <= f < 45 and f != 50], "segment string, frame long")
    touch = frame(spark, [("s", f, "1") for f in range(5)], "segment string, frame long, owner string")
    shots = frame(spark, [("s", 32, 36, True, 38)], "segment string, anchor long, end long, made boolean, resolved long")
    got = E.possession_spans(frames, ids, shots, balls, touch, FPS).orderBy("start").collect()
    assert [(r["start"], r["end"], r["state"], r["owner"]) for r in got] == [
        (0, 5, "held", "1"), (5, 10, "dribble", "1"), (10, 15, "pass_flight", None), (15, 25, "dribble", "2"), (25, 30, "loose", None),
        (30, 32, "dribble", "3"), (32, 36, "shot_flight", None), (36, 39, "dribble", "3"), (39, 68, "dead", None), (68, 70, "loose", None),
    ]


def test_links_between_events(spark):
    shots = frame(spark, [("s", "m1", 100, "7", "missed", "confirmed"), ("s", "m2", 90, "7", "missed", "uncertain"), ("s", "x", 400, "9", "made", "confirmed")], "segment string, event_id string, anchor long, shooter string, outcome string, status string")
    misses = shots.where("outcome = 'missed'").withColumn("resolved", shots["anchor"] + 10)
    controls = frame(spark, [("s", "4", 120, 130), ("s", "5", 300, 310), ("s", "9", 395, 400)], "segment string, owner string, start long, end long")
    got = E.rebounds(misses, shots, controls, FPS).collect()
    assert [(r["event_id"], r["frame"], r["rebounder"]) for r in got] == [("m1", 120, "4")]
    passes = frame(spark, [("s", "p1", 310, "5", "9"), ("s", "p2", 330, "6", "9"), ("s", "p3", 340, "6", "8")], "segment string, event_id string, anchor long, passer string, receiver string")
    (a,) = E.assists(passes, shots.where("outcome = 'made'"), shots, controls, FPS).collect()
    assert (a["event_id"], a["pass_id"], a["passer"]) == ("x", "p2", "6")
    more = controls.union(frame(spark, [("s", "3", 350, 360)], controls.schema))
    assert E.assists(passes, shots.where("outcome = 'made'"), shots, more, FPS).collect() == []
    steals = frame(spark, [("s", "t1", 350, "9"), ("s", "t2", 100, "9")], "segment string, event_id string, anchor long, shooter string")
    assert [(r["event_id"], r["to_score"]) for r in E.follow_ups(steals, shots, "shooter", 4, FPS, "to_score").collect()] == [("t1", "x")]


def test_visits_and_clips(spark):
    shots = frame(spark, [("s", 100, 90, 150)], "segment string, anchor long, start long, end long")
    visits = frame(spark, [("s", i, p) for i, p in enumerate((50, 60, 149, 145, 150, 99))], "segment string, visit long, peak long")
    assert {r["peak"] for r in E.uncovered_visits(visits, shots, FPS).collect()} == {50, 150}
    events = frame(spark, [("s", "e", 150, 150, 220)], "segment string, event_id string, anchor long, start long, end long")
    controls = frame(spark, [("s", "1", 60, 140), ("s", "2", 145, 148)], "segment string, owner string, start long, end long")
    (c,) = E.clip_spans(events, controls, FPS).collect()
    assert (c["clip_start"], c["clip_end"]) == (45, 265)
    (c,) = E.clip_spans(events, controls.limit(0), FPS).collect()
    assert c["clip_start"] == 135
