import numpy as np
import pytest

from framelake.llm import embedding_dedup
from framelake.llm.embedding_dedup import near_vectors


def sample(n=500, dim=32):
    r = np.random.default_rng(3)
    base = r.standard_normal((n, dim))
    out = [*base]
    for i in range(60):
        x = base[i] / np.linalg.norm(base[i])
        y = r.standard_normal(dim)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cos = 0.88 + 0.12 * i / 60
        out.append(3 * (cos * x + np.sqrt(1 - cos**2) * y))
    out += [base[100] + 0.02 * r.standard_normal(dim) for _ in range(120)]
    out += [base[7]] * 5
    return np.array(out).astype(np.float32)


def brute_force(vectors):
    x = vectors.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


@pytest.mark.parametrize("tile", [1024, 16])
def test_recall_and_no_false_link(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    vectors = sample()
    links, root = brute_force(vectors)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(near_vectors(df).collect(), key=lambda r: r["vec_id"])
    n = np.array([r["n_links"] for r in got])
    assert (n <= links).all() and n.sum() >= 0.99 * links.sum()
    assert np.mean([r["component_id"] == root[i] for i, r in enumerate(got)]) > 0.98
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_bad_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, m long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 11: (2, 1, False), None: (0, None, True), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}}
    assert near_vectors(df.limit(0)).collect() == []


def test_centred_data_two_lengths_and_shared_names(spark):
    r = np.random.default_rng(5)
    shift = 0.5 * np.ones(32)
    base = np.concatenate([r.standard_normal((300, 32)) / 5.6 + shift] * 1)
    near = [x * 2 + 0.02 * r.standard_normal(32) for x in base[:80]]
    vectors = np.array([*base, *near])
    links, _ = brute_force(vectors)
    short = r.standard_normal((40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, v.tolist()) for i, v in enumerate(short)] + [(2000 + i, (v * 3).tolist()) for i, v in enumerate(short)] + [(0, short[0].tolist())]
    got = near_vectors(spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, rep long").repartition(3)).collect()
    assert len(got) == len(rows)
    n = sum(x["n_links"] for x in got if x["vec_id"] < 1000)
    assert 0.99 * links.sum() <= n - 2 <= links.sum() + 2
    by_id = {(x["vec_id"], x["component_id"]) for x in got}
    assert all((2000 + i, 1000 + i) in by_id for i in range(1, 40) if (1000 + i, 1000 + i) in by_id) and (2000, 0) in by_id


def test_recall_with_long_substrings(spark, monkeypatch):
    plan = embedding_dedup.plan
    monkeypatch.setattr(embedding_dedup, "plan", lambda n, chance, miss: plan(10_000_000, chance, miss))
    vectors = sample(300)
    links, _ = brute_force(vectors)
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()
    assert 0.98 * links.sum() <= sum(x["n_links"] for x in got) <= links.sum()
