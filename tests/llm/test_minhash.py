import re

from corpus_text import changed, prose

from framelake.llm.minhash import near_duplicates


def brute_force(rows):
    sets, parent = {}, {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        parent[doc_id] = doc_id

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def test_components_match_all_pairs(docs, texts):
    got = near_duplicates(docs).collect()
    want = brute_force(texts)
    assert len(got) == len(texts)
    assert len({r["component_id"] for r in got}) < len(want) - 20
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]], r["doc_id"]


def test_central_text_joins_copies_that_are_unlike(spark):
    base = prose(5, 400)
    rows = [(100 - i if i else 7000, changed(base, i, 0.02) if i else base, None, None) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    want = brute_force(rows)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {d: w[1] for d, w in want.items()}


def test_null_ids_and_no_rows(spark, no_docs):
    assert near_duplicates(no_docs).collect() == []
    got = near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(False, 4, True)]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a), (5, b), (5, a), (5, a), (7, b + " tail"), (9, None), (9, a + " more")]
    df = spark.createDataFrame([(*x, "r", 1) for x in rows], "doc_id long, text string, rep string, component int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 5, False), (9, 3, False), (9, 9, True)]
