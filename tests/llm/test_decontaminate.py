import re

from framelake.llm.decontaminate import contained_items, drop_contaminated

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and then it sleeps all day long"),
    (2, "Three short words"),
    (3, "Three short words"),
    (4, None),
    (5, "!!! ..."),
    (6, "one two three four five"),
    (7, " ".join(f"word{i}" for i in range(60))),
]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_force(rows, items=ITEMS):
    out = set()
    for doc_id, text, *_ in rows:
        w = words(text)
        for item, t in items:
            v = words(t)
            n = min(5, len(v))
            want = runs(v, n) if n else set()
            if want and len(want & runs(w, n)) >= 0.75 * len(want):
                out.add((doc_id, item, len(want), len(want & runs(w, n))))
    return out


def rows(texts):
    seven = ITEMS[6][1].split()
    more = [
        "x " * 300 + ITEMS[0][1].upper().replace(" ", "!! ") + " y" * 4000,
        "and THREE, short words here",
        "one two three four six",
        "say one two three four five!",
        " ".join(seven[:47]),
        " ".join(seven[:46]),
        " ".join(["zz", *seven[3:]]),
        " ".join(seven[:20] + ["q"] + seven[21:40] + ["q"] + seven[41:]),
        "the quick brown fox jumps over",
    ]
    return [*texts, *[(900 + i, t, "en", "s") for i, t in enumerate(more)]]


def test_matches_brute_force(spark, texts):
    every = rows(texts)
    docs = spark.createDataFrame([(*t, 3) for t in every], "doc_id long, text string, lang string, source string, item_id long")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    got = contained_items(docs, items).collect()
    want = brute_force(every)
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got} == want
    assert {900, 901, 903, 904, 906} <= {w[0] for w in want} and len(got) == len(want)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    bad = {w[0] for w in want}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(t[0] for t in every if t[0] not in bad)


def test_no_rows(spark, docs, no_docs, texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contained_items(no_docs, items).collect() == []
    assert contained_items(docs, items.limit(0)).collect() == []
    assert drop_contaminated(docs, items.limit(0)).count() == len(texts)


def test_main_path_is_native(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = contained_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rows_that_share_an_id_and_clashing_names(spark):
    rows = [(1, "so " + ITEMS[5][1]), (1, "a clean text"), (None, ITEMS[5][1]), (2, None), (1, "so " + ITEMS[5][1])]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, hash int, bad_id int")
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, w string, words int")
    assert [(r["doc_id"], r["item_id"]) for r in contained_items(docs, items).collect()] == [(1, 6)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r["text"]) for r in kept.collect()) == sorted(["a clean text", ITEMS[5][1], "None"])
