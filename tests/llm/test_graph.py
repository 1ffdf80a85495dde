import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.llm import graph


def brute_force(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        if v not in out:
            work = [v]
            while work:
                x = work.pop()
                if x not in out:
                    out[x] = v
                    work += near[x]
    return out


def sample():
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(90)] + [(-5, 3000 + i) for i in range(40)]
    r.shuffle(edges)
    return [e for e in edges if e[0] != e[1]]


def test_labels_in_one_task():
    edges = sample()
    v, c = graph.least_labels(*np.array(edges).T)
    assert dict(zip(v.tolist(), c.tolist(), strict=True)) == brute_force(edges)


@pytest.mark.parametrize("chunk", [200_000, 1])
def test_components(spark, monkeypatch, chunk):
    edges = sample()
    monkeypatch.setattr(graph, "_thin", thinned(chunk))
    df = spark.createDataFrame([*edges, (1, 1), (None, 4), edges[0]], "a long, b long")
    got = {r["v"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == brute_force(edges)
    assert graph.connected_components(df.limit(0)).collect() == []


def thinned(chunk):
    """Links as they are: all the work is left to the rounds over all tasks."""
    if chunk > 1:
        return graph._thin

    def run(batches):
        yield from batches

    return run


def counted(monkeypatch):
    tables = []
    write = graph.write_table
    monkeypatch.setattr(graph, "write_table", lambda df, name: tables.append(name) or write(df, name))
    return tables


@pytest.mark.parametrize(("chunk", "long"), [(50_000, 100_000), (1, 400)])
def test_rounds_on_chains(spark, monkeypatch, chunk, long):
    monkeypatch.setattr(graph, "_thin", thinned(chunk))
    tables = counted(monkeypatch)
    ids = random.Random(3).sample(range(10_000_000), long)
    up, down = list(range(20_000_000, 20_000_060)), [30_000_000, *range(30_000_060, 30_000_000, -1)]
    edges = [e for chain in (ids, up, down) for e in zip(chain, chain[1:], strict=False)]
    df = spark.createDataFrame(pd.DataFrame(random.Random(1).sample(edges, len(edges)), columns=["a", "b"])).repartition(4)
    got = graph.connected_components(df).toPandas().set_index("v")["component"].to_dict()
    assert got == {v: low for low, chain in ((min(c), c) for c in (ids, up, down)) for v in chain}
    assert tables.count("edges") <= 18 and tables.count("jumped") <= 40


def test_hub(spark, monkeypatch):
    monkeypatch.setattr(graph, "_thin", thinned(1))
    tables = counted(monkeypatch)
    df = spark.range(300_000).select(F.lit(5_000_000).alias("a"), (F.col("id") * 3).alias("b"))
    got = graph.connected_components(df)
    assert got.count() == 300_001 and got.select("component").distinct().collect() == [(0,)]
    assert tables.count("edges") <= 4


def test_look_up_of_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 5)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1] * 20 + [2] * 20 + [3, 4, None])], "i long, k long")
    table = spark.createDataFrame([(1, 10), (3, 30), (9, 90)], "v long, x long")
    got = {r["i"]: r["x"] for r in graph.look_up(rows, "k", table, 43, "x").collect()}
    assert got == {i: {1: 10, 3: 30}.get(k) for i, k in enumerate([1] * 20 + [2] * 20 + [3, 4, None])}


def test_least_names(spark):
    edges = spark.createDataFrame([(100, 50), (50, 70), (8, 9)], "a long, b long")
    names = spark.createDataFrame([(100, 1), (50, 7), (70, 7), (8, 4), (9, 2), (77, 0)], "v long, n long")
    assert {tuple(r) for r in graph.least_names(edges, names).collect()} == {(100, 1), (50, 1), (70, 1), (8, 2), (9, 2)}


def test_keys_that_unlike_rows_share_are_told_apart(spark):
    from framelake.llm.common import told_apart

    rows = [(i, 7 if i % 3 else 8, i % 2, i % 5) for i in range(60)] + [(100, None, 1, 1)]
    table = spark.createDataFrame(rows, "id long, key long, d1 long, d2 long")
    got = told_apart(table, "key", "d1", "d2").collect()
    by = {}
    for r in got:
        if r["key"] is not None:
            by.setdefault(r["key"], set()).add((r["d1"], r["d2"]))
    assert all(len(x) == 1 for x in by.values()) and sorted(r["id"] for r in got) == [*range(60), 100]
    same = {}
    for r in got:
        same.setdefault((rows[r["id"]][1] if r["id"] < 60 else None, r["d1"], r["d2"]), set()).add(r["key"])
    assert all(len(x) == 1 for x in same.values()) and {7, 8} <= set(by)
    apart = table.where("id < 2")
    assert told_apart(apart, "key", "d1", "d2") is apart
