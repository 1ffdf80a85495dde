"""Shots from contacts, checks of plans and summaries on small tables, against loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from framelake.operators import integrity, shots, summaries

FPS = 30.0


def _loop(visits, passages, proposals, controls):
    used, out = set(), {}
    for begin, visit, end in sorted((b, v, e) for v, b, e in visits):
        near = [c for c in passages if begin - 12 <= c <= end]
        if not near:
            continue
        free = sorted(p for p in proposals if p not in used and begin - 90 <= p[0] < min(near))
        if free:
            used.add(free[-1])
            out[visit] = (*free[-1], "proposal")
            continue
        held = sorted((s, e - 1, o) for o, s, e in controls if begin - 90 <= e - 1 <= begin)
        out[visit] = (held[-1][1], held[-1][2], "control") if held else (None, None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_proposal_serves_one_visit(spark, seed):
    r = random.Random(seed)
    visits, passages, proposals, controls, want = [], [], [], [], {}
    for segment in ("s", "t"):
        v = [(100 * i + r.randrange(3), b, b + r.randrange(8)) for i, b in enumerate(sorted(r.sample(range(60, 4000), 60)))]
        c = [r.randrange(4000) + 0.5 for _ in range(160)]
        p = sorted({(r.randrange(4000), r.choice("abc")) for _ in range(40)})
        k = [(r.choice("abc"), s, s + r.randrange(1, 40)) for s in sorted(r.sample(range(4000), 60))]
        visits += [(segment, *x) for x in v]
        passages += [(segment, x) for x in c]
        proposals += [(segment, *x) for x in p]
        controls += [(segment, *x) for x in k]
        want |= {(segment, visit): got for visit, got in _loop(v, c, p, k).items()}
    done = shots.visit_releases(
        spark.createDataFrame(visits, "segment string, visit long, begin long, end long"),
        spark.createDataFrame(passages, "segment string, crossing double"),
        spark.createDataFrame(proposals, "segment string, release long, player string"),
        spark.createDataFrame(controls, "segment string, owner string, start long, end long"),
        FPS,
    )
    assert {(x.segment, x.visit): (x.release, x.player, x.source) for x in done.collect()} == want
    assert {s for _, _, s in want.values()} >= {"proposal", "control"}


def _scene(spark, hand_y, path):
    joints = [(1.0, 50.0, 0.9)] * 17
    joints[9] = (1.0, hand_y, 0.9)
    poses = spark.createDataFrame([("s", 10, "a", "p1", joints)], "segment string, frame long, view string, player string, keypoints array<struct<x: double, y: double, confidence: double>>")
    samples = spark.createDataFrame([("s", "a", 10 + f, x, y) for f, x, y in path], "segment string, view string, frame long, x double, y double")
    rims = spark.createDataFrame([("s", "a", 100.0, 20.0, 40.0)], "segment string, view string, cx double, cy double, width double")
    contacts = spark.createDataFrame([("s", "p1", 10)], "segment string, player string, frame long")
    return contacts, poses, samples, rims


TO_RIM = [(0, 10.0, 60.0), (2, 30.0, 50.0), (4, 60.0, 35.0), (6, 80.0, 25.0)]


@pytest.mark.parametrize(
    ("hand_y", "path", "seen"),
    [(40.0, TO_RIM, 1), (60.0, TO_RIM, 0), (40.0, TO_RIM[:2], 0), (40.0, [(0, 10.0, 60.0), (2, 30.0, 50.0), (9, 80.0, 25.0)], 0), (40.0, [(f, 100 - x, 60.0) for f, x, _ in TO_RIM], 0), (40.0, [(f, 10 + f / 2, 60.0) for f, _, _ in TO_RIM], 0)],
)
def test_release_needs_a_raised_hand_and_a_flight_to_the_rim(spark, hand_y, path, seen):
    assert shots.release_views(*_scene(spark, hand_y, path), FPS).count() == seen


def test_a_contact_becomes_a_shot_with_its_pass(spark):
    contacts, poses, samples, rims = _scene(spark, 40.0, TO_RIM)
    visits = spark.createDataFrame([("s", 1, 16, 30)], "segment string, visit long, begin long, end long")
    passages = spark.createDataFrame([("s", "a", 20.5, "inside")], "segment string, view string, crossing double, result string")
    controls = spark.createDataFrame([("s", "p2", 0, 4, 1), ("s", "p1", 6, 11, 1)], "segment string, owner string, start long, end long, team long")
    net = spark.createDataFrame([("s", f, 0.5 if f > 21 else 0.1) for f in range(60)], "segment string, frame long, change double")
    row = shots.detect_shots(contacts, poses, samples, rims, passages, visits, controls, net, FPS, "a").collect()
    assert [(x.visit, x.anchor, x.player, x.source, x.views, x.passer, x.passed) for x in row] == [(1, 10, "p1", "proposal", ["a"], "p2", 3)]
    assert (row[0].number, row[0].outcome, row[0].confidence, row[0].resolution) == (1, "made", "confirmed", 20)
    left = shots.detect_shots(contacts, poses, samples, rims, passages, visits.withColumn("begin", F.col("begin") + 200).withColumn("end", F.col("end") + 200), controls, net, FPS, "a").collect()
    assert [(x.visit, x.anchor, x.player, x.outcome, x.confidence, x.passer) for x in left] == [(None, 10, "p1", "unknown", "probable", "p2")]
    other = controls.replace({"p2": "p3"}).selectExpr("segment", "owner", "start", "end", "if(owner = 'p3', 2, 1) as team")
    assert shots.detect_shots(contacts, poses, samples, rims, passages, visits, other, net, FPS, "a").first().passer is None


def test_checks_raise_with_the_rows_that_break_them(spark):
    plan = spark.createDataFrame([(1, 0, 10, [3, 12]), (2, 10, 20, [10])], "clip long, start long, end long, critical_frames array<long>")
    with pytest.raises(ValueError, match=r"Critical.*12"):
        integrity.require_empty(integrity.outside(plan), "Critical frames outside their clip")
    integrity.require_empty(integrity.outside(plan.where("clip = 2")), "none")
    cuts = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12), (2, 3, 4)], "clip long, start long, end long")
    assert [r.start for r in integrity.broken_cuts(cuts).collect()] == [10]


def test_triples_are_different_and_repeat(spark):
    drawn = summaries.index_triples(7, 50)
    assert drawn == summaries.index_triples(7, 50) and all(len(set(t)) == 3 and max(t) < 7 for t in drawn)
    state, want = 1234567, []
    for _ in range(150):
        state = (state * 1103515245 + 12345) % 2**31
        want.append(state % 7)
    assert drawn == [t for t in zip(*[iter(want)] * 3, strict=True) if len(set(t)) == 3]


def test_unknown_appearance_costs_a_half(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = [r.d for r in rows.select(summaries.appearance_distance(rows.a, rows.b).alias("d")).collect()]
    assert got == [0.5, 0.5, 1.0]


def _moved(net, anchor):
    """Whether the net moves, over a list of (frame, change)."""
    near = sorted((f, c) for f, c in net if anchor - 15 <= f < anchor + 24)
    rest, after = [c for f, c in near if f < anchor - 3], [c for f, c in near if f >= anchor - 3]
    base = statistics.median([c for c in rest if c is not None] or [0.0])
    longest = run = 0
    for c in after:
        run = run + 1 if c is not None and c >= max(0.22, base + 0.16) else 0
        longest = max(longest, run)
    return longest >= 3 and len(rest) >= 3 and len(after) >= 1


def outcome_loop(visit, passages, net, result_view="a", least=1, views=("a", "b", "c")):
    begin, end = visit
    seen = sorted((p for p in passages if begin - 12 <= p[1] <= end), key=lambda p: (views.index(p[0]), p[1]))
    if not seen:
        return None
    groups = []
    for p in sorted((p for p in seen if p[2] == "inside"), key=lambda p: p[1]):
        if not groups or p[1] - groups[-1][0][1] > 12:
            groups.append([])
        groups[-1].append(p)
    confidence = "probable"
    for g in groups:
        t, who = statistics.median(p[1] for p in g), {p[0] for p in g}
        if any(p[2] == "outside" and abs(p[1] - t) <= 6 for p in seen) or not (len(who) >= max(2, least) or result_view in who and least <= 1):
            continue
        own = [p[1] for p in g if p[0] == result_view]
        t = round(statistics.median(own) if own else t)
        if _moved(net, t):
            return "made", "confirmed", t
        confidence = "unconfirmed"
    if not groups:
        for p in [p for p in seen if p[2] == "outside"]:
            near = [q for q in seen if q[2] == "outside" and abs(q[1] - p[1]) <= 6]
            if len({q[0] for q in near}) >= 2:
                return "missed", "confirmed", round(statistics.median(q[1] for q in near))
    return "unknown", confidence, None


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 2), (3, 3)])
def test_outcomes_match_a_loop(spark, seed, least):
    r = random.Random(seed)
    visits, passages, net, want = [], [], [], {}
    for s in ("s", "t"):
        own, at = [], 0
        series = [(f, None if r.random() < 0.1 else r.choice((0.05, 0.1, 0.3)) if f % 100 < 50 else 0.6) for f in range(6200) if r.random() < 0.98]
        for v in range(60):
            at += r.randrange(40, 100)
            visits.append((s, v, at, at + r.randrange(25)))
            kinds = r.choice((["inside"], ["outside"], ["outside", "edge"], ["inside", "outside", "edge"]))
            for _ in range(r.randrange(6)):
                # Quarters of a frame, so medians can lie half way between two frames.
                own.append((r.choice("abc"), at + r.randrange(-60, 100) / 4, r.choice(kinds)))
        passages += [(s, *p) for p in own]
        net += [(s, *x) for x in series]
        want |= {(s, v): outcome_loop((b, e), own, series, least=least) for t, v, b, e in visits if t == s}
    got = shots.outcomes(
        spark.createDataFrame(visits, "segment string, visit long, begin long, end long"),
        spark.createDataFrame(passages, "segment string, view string, crossing double, result string"),
        spark.createDataFrame(net, "segment string, frame long, change double"),
        FPS, "a", least, ("a", "b", "c"),
    )
    assert {(x.segment, x.visit): (x.outcome, x.confidence, x.resolution) for x in got.collect()} == {k: w for k, w in want.items() if w}
    assert {w[0] for w in want.values() if w} == {"made", "missed", "unknown"}
