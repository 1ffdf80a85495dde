import re
from collections import defaultdict

from framelake.llm import mixing


def fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Targets by repeated sharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def expected(rows):
    size = {t[0]: len(re.findall(r"[^\x20\x09-\x0D]+", t[1] or "")) for t in rows}
    sums = defaultdict(int)
    for t in rows:
        sums[t[3]] += size[t[0]]
    return size, sums, fill(sums)


def test_targets_and_rounding(docs, texts):
    got = mixing.mix_sources(docs).collect()
    size, sums, want = expected(texts)
    assert len(got) == len(texts)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sums:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_tree_of_groups_gives_the_same_on_each_run(docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 3)
    monkeypatch.setattr(mixing, "FAN", 2)
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    first = key(mixing.mix_sources(docs))
    assert first == key(mixing.mix_sources(docs.repartition(5)))
    assert len(first) == docs.count()


def test_expected_copies(spark):
    rows = [(i, "w " * (i % 9 + 1), None, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total = defaultdict(float)
    for seed in range(6):
        for r in mixing.mix_sources(df, seed=seed).collect():
            total[r["source"]] += r["copies"] / 6 / 200
    _, sums, want = expected(rows)
    for s in "ab":
        assert abs(total[s] - want[s] / sums[s]) < 0.08


def test_no_rows(no_docs):
    assert mixing.mix_sources(no_docs).collect() == []


def test_many_sources_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 10)
    rows = [(None, "w " * (i % 5 + 1), f"s{i % 37:02d}") for i in range(300)] + [(7, "a b c", None)] * 60 + [(8, "q " * i, "s00") for i in range(20)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, row int, part double")
    got = mixing.mix_sources(df.repartition(3)).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sums = defaultdict(int)
    for _, t, s in rows:
        sums[s] += len(t.split())
    want, taken = fill(sums), defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 19 for s in sums)
