"""Neighbours, assignments and suppression beside brute force on random tables."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from framelake.operators import matching, ranking


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_TILE", 7)
    monkeypatch.setattr(ranking, "MEMORY_TILE", 40)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 1, 5).tolist(), f"l{i % 3}") for i in range(150)]
    rows += [(200 + i, rows[3][1], "copy") for i in range(30)] + [(300, [0.0] * 5, "zero"), (301, None, "null"), (302, [1.0, 2.0], "short"), (303, [1.0, None, 2.0, 3.0, 4.0], "hole")]
    memory = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    queries = spark.createDataFrame([(f"q{i}", v) for i, v, _ in rows if i % 10 == 3 or i >= 300], "query string, q_vector array<double>")
    got = ranking.retrieve(queries, memory, 6).collect()
    good = [(i, np.array(v), x) for i, v, x in rows if v and None not in v and any(v)]
    want = set()
    for i, v, _ in good:
        if i % 10 == 3 or i >= 300:
            near = sorted((-round(float(v @ m / np.linalg.norm(v) / np.linalg.norm(m)), 9), j, x) for j, m, x in good if len(m) == len(v))
            want |= {(f"q{i}", j, x, -s, n) for n, (s, j, x) in enumerate(near[:6], 1)}
    assert {(x["query"], x["id"], x["label"], round(x["similarity"], 9), x["rank"]) for x in got} == want and len(got) == len(want)
    assert ranking.retrieve(queries.limit(0), memory, 6).count() == ranking.retrieve(queries, memory.limit(0), 6).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_assignment_by_clusters_matches_all_orders(seed):
    r = random.Random(seed)
    cost = {(f"r{a}", f"c{b}"): r.randrange(9) for a in range(6) for b in range(7) if r.random() < (0.15, 0.3, 0.6)[seed % 3]}
    cost[("r0", "c0")] = 3
    group = pd.DataFrame([("k", a, b, float(x)) for (a, b), x in cost.items()], columns=["key", "row", "col", "cost"]).sample(frac=1, random_state=seed)
    got = matching._assign(group, ["key"])
    assert got["row"].is_unique and got["col"].is_unique and list(got.columns) == ["key", "row", "col", "cost"]
    assert all(cost[a, b] == x for a, b, x in zip(got["row"], got["col"], got["cost"], strict=True))
    best = (0, 0)
    for order in itertools.permutations([f"c{b}" for b in range(7)], 6):
        c = [cost[p] for p in zip([f"r{a}" for a in range(6)], order, strict=True) if p in cost]
        best = max(best, (len(c), -sum(c)))
    assert (len(got), -got["cost"].sum()) == best


@pytest.mark.parametrize("seed", [1, 2])
def test_slots_match_a_loop(spark, seed):
    r = random.Random(seed)
    events = [(k, f"e{i}", r.randrange(2000)) for k in "ab" for i in range(120)]
    slots = [(k, f"s{i}", s, s + r.randrange(40)) for k in "ab" for i in range(100) for s in [r.randrange(2000)]]
    got = matching.match_slots(spark.createDataFrame(events, "kind string, event string, at long"), spark.createDataFrame(slots, "kind string, slot string, start long, end long"), "kind", 16.0)
    taken, want = set(), set()
    for kind, event, at in sorted(events, key=lambda e: (e[2], e[1])):
        free = [(abs((s + e) / 2 - at), slot) for k, slot, s, e in slots if k == kind and s <= at <= e and (k, slot) not in taken]
        if free:
            taken.add((kind, min(free)[1]))
            want.add((kind, event, min(free)[1]))
    assert set(map(tuple, got.collect())) == want and len(want) > 60


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    area = lambda x: max(x[2] - x[0], 0) * max(x[3] - x[1], 0)
    total = area(a) + area(b) - both
    return both / total if total else 0.0


def greedy(rows, near):
    """Ids in order of score that are not near a kept one."""
    kept = []
    for det, score, x in sorted(rows, key=lambda r: (-r[1], r[0])):
        if not any(near(x, y) for _, y in kept):
            kept.append((det, x))
    return {d for d, _ in kept}


BOXES = "image long, label string, det long, score double, box struct<x1:double,y1:double,x2:double,y2:double>"


def random_boxes(seed, n=240):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        x, y = r.randrange(-40, 60), r.randrange(-40, 60)
        rows.append((r.randrange(4), r.choice("ab"), d, r.randrange(20) / 20, (float(x), float(y), float(x + r.randrange(0, 40)), float(y + r.randrange(0, 40)))))
    return rows


@pytest.mark.parametrize("cell", [5.0, 64.0])
def test_suppression_by_cells(spark, cell):
    rows = random_boxes(1)
    df = spark.createDataFrame(rows, BOXES)
    got = {(x["image"], x["det"]) for x in ranking.suppress(df, ["image"], 0.3, cell).collect()}
    want = {(i, d) for i in range(4) for d in greedy([(x[2], x[3], x[4]) for x in rows if x[0] == i], lambda a, b: overlap(a, b) > 0.3)}
    assert got == want and len(want) < len(rows)
    ranked = ranking.suppress_classes(df, ["image"], "label", 0.3, 0.4, cell).collect()
    want = {(i, c, d) for i in range(4) for c in "ab" for d in greedy([(x[2], x[3], x[4]) for x in rows if x[:2] == (i, c) and x[3] > 0.4], lambda a, b: overlap(a, b) > 0.3)}
    assert {(x["image"], x["label"], x["det"]) for x in ranked} == want
    for i in range(4):
        own = sorted((x for x in ranked if x["image"] == i), key=lambda x: x["rank"])
        assert [x["rank"] for x in own] == list(range(1, len(own) + 1)) and [x["score"] for x in own] == sorted((x["score"] for x in own), reverse=True)


def test_masks(spark):
    from framelake.operators import masks

    r = np.random.default_rng(2)
    width, height, pictures = 17, 11, {}
    for d in range(24):
        m = np.zeros((height, width), bool)
        x, y = r.integers(0, width), r.integers(0, height)
        m[y : y + r.integers(1, 8), x : x + r.integers(1, 10)] = True
        m &= r.random(m.shape) < (1.0 if d % 2 else 0.8)
        pictures[d % 2, d] = m
    pictures[0, 99] = np.zeros((height, width), bool)
    raw = spark.createDataFrame([(i, d, m.astype(int).ravel().tolist()) for (i, d), m in pictures.items()], "image long, det long, pixels array<int>")
    from pyspark.sql import functions as F

    runs = masks.runs_of(raw, ["image"], "pixels", F.lit(width))
    back = {k: np.zeros((height, width), bool) for k in pictures}
    for x in runs.collect():
        assert not back[x["image"], x["det"]][x["y"], x["x0"] : x["x1"]].any()
        back[x["image"], x["det"]][x["y"], x["x0"] : x["x1"]] = True
    assert all((back[k] == m).all() for k, m in pictures.items())
    got = {(x["image"], x["det"], x["o_det"]): (x["common"], x["iou"], x["ioa"]) for x in masks.overlaps(runs, runs, ["image"]).collect()}
    want = {(i, a, b): ((m & o).sum(), (m & o).sum() / (m | o).sum(), (m & o).sum() / o.sum()) for (i, a), m in pictures.items() for (j, b), o in pictures.items() if i == j and (m & o).any()}
    assert got == want
    scores = [(i, d, "uv"[d % 3 == 0], float(r.integers(0, 9)) / 9) for i, d in pictures]
    table = spark.createDataFrame(scores, "image long, det long, label string, score double")
    iou = lambda a, b: (a & b).sum() > 0.2 * (a | b).sum()
    kept = {(x["image"], x["det"]) for x in masks.suppress(runs, table, ["image"], 0.2).collect()}
    assert kept == {(i, d) for i in (0, 1) for d in greedy([(d, s, pictures[i, d]) for j, d, _, s in scores if j == i], iou)}
    ranked = {(x["image"], x["label"], x["det"]) for x in masks.suppress_classes(runs, table, ["image"], "label", 0.2, 0.3).collect()}
    assert ranked == {(i, c, d) for i in (0, 1) for c in "uv" for d in greedy([(d, s, pictures[i, d]) for j, d, k, s in scores if (j, k) == (i, c) and s > 0.3], iou)}


def plain_ap(hits, positives):
    """Area under the envelope of precision over recall."""
    points, tp = [(0.0, 0.0)], 0
    for n, hit in enumerate(hits, 1):
        tp += hit
        points.append((tp / positives, tp / n))
    points.append((1.0, 0.0))
    for i in range(len(points) - 2, -1, -1):
        points[i] = (points[i][0], max(points[i][1], points[i + 1][1]))
    return sum((b[0] - a[0]) * b[1] for a, b in itertools.pairwise(points))


def test_detection_metrics(spark):
    r = random.Random(4)
    truth = [(i, c, d, b, r.random() < 0.2) for i, c, d, _, b in random_boxes(5, 80)] + [(0, "c", 900, (0.0, 0.0, 5.0, 5.0), False), (0, "d", 901, (0.0, 0.0, 5.0, 5.0), True)]
    found = []
    for n, (i, c, _, b, _) in enumerate(truth * 2):
        if c != "c" and r.random() < 0.8:
            # Scores are all different, so that no order is left open.
            found.append((i, r.choice((c, c, "a")), 1000 + n, (n * 37 % 163) / 163, tuple(v + r.choice((0, 0, 1, 3)) for v in b)))
    found.append((0, "a", 5000, 0.99, (5.0, 5.0, 5.0, 9.0)))
    classes, means = ranking.evaluate_detections(
        spark.createDataFrame(found, BOXES), spark.createDataFrame(truth, "image long, label string, gt long, gt_box struct<x1:double,y1:double,x2:double,y2:double>, difficult boolean"), ["image"], "label"
    )
    judged, taken = [], set()
    for i, c, _, score, b in sorted(found, key=lambda x: -x[3]):
        if b[0] >= b[2] or b[1] >= b[3]:
            continue
        own = [(overlap(b, t[3]), -t[2], t) for t in truth if t[:2] == (i, c)]
        best = max(own, key=lambda x: x[:2], default=None)
        if best and best[0] >= 0.5:
            if not best[2][4]:
                judged.append((c, score, best[2][2] not in taken))
                taken.add(best[2][2])
        else:
            judged.append((c, score, False))
    n = {c: sum(t[1] == c and not t[4] for t in truth) for c in "abcd"}
    want = {c: plain_ap([h for k, _, h in judged if k == c], n[c]) if n[c] else None for c in n}
    got = {x["label"]: x["ap"] for x in classes.collect()}
    assert set(got) == set(want) and got["d"] is None and got["c"] == 0
    assert all(abs(got[c] - want[c]) < 1e-9 for c in "abc")
    one = means.first()
    assert abs(one["map"] - np.mean([want[c] for c in "abc"])) < 1e-9
    assert abs(one["pooled"] - plain_ap([h for c, _, h in judged if n[c]], sum(n.values()))) < 1e-9
