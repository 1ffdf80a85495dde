import random
import re
from collections import Counter
from itertools import permutations

from framelake.llm import graph
from framelake.llm.filter_audit import audit_filters, word_counts


def brute_force(docs, labels):
    """Every order of the filters, step by step over all documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ""
        f += "A" if len(w) < 200 else ""
        f += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        f += "D" if re.search(r"[#$%&*|]", t) else ""
        f += "E" if any(j is not None and doc_id is not None and j < doc_id and (u or "") == t for j, u, _ in docs) else ""
        fails.append((lang or "", f, doc_id))
    out, sums = [], Counter()
    for part in sorted({x[0] for x in fails}):
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                before = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += now
                only = sum(x[1] == f for x in fails if x[0] == part)
                out.append([part, "".join(order), step, len(left), len(now), before, only, sum(x[2] in good for x in now), sum(x[2] in toxic for x in now), f])
                sums[part, f] += len(now)
    return sorted((*x[:-1], sums[x[0], x[-1]]) for x in out)


def check(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, lang string, word int, mask int, key int").repartition(3)
    x = spark.createDataFrame([(*y, "x") for y in labels], "doc_id long, quality int, toxic int, part string")
    out = audit_filters(d, x)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == brute_force(docs, labels)


def several(seed):
    r = random.Random(seed)
    docs = []
    for i in range(120):
        n = r.choice((0, 3, 199, 200, 201, 400))
        words = [r.choice(("a", "b", "Cc", "d|", "é", "W" * 9)) if r.random() < 0.4 else f"w{r.randrange(400)}" for _ in range(n)]
        docs.append((r.randrange(80), r.choice((" ", "\n ", "\x0b", "\xa0")).join(words), r.choice(("en", "fr", "", None))))
    docs += [(r.randrange(200), docs[r.randrange(120)][1], "en") for _ in range(60)] + [docs[3], docs[3], (None, docs[4][1], "fr"), (None, docs[4][1], "fr"), (None, None, None), (5, None, "en"), (9, "", "en")]
    docs += [(500 + i, "same text\tagain", r.choice(("en", "fr"))) for i in range(40)] + [(900, "word " * 30_000, "en"), (901, " \t\n", "de")]
    labels = [(r.randrange(210), r.choice((0, 1, None)), r.choice((0, 1, None))) for _ in range(150)] + [(None, 1, 1), (77_777, 1, 1)]
    return docs, labels


def test_matches_every_order(spark):
    check(spark, *several(1))


def test_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 20)
    check(spark, *several(2))


def test_one_part_without_labels(spark):
    check(spark, [(1, "A", None)], [])


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit_filters(docs, labels).collect() == []


def test_words_take_one_shuffle(spark):
    rows = spark.createDataFrame([(1, 2, "a a b"), (3, 4, " ")], "doc_id long, key long, text string")
    out = word_counts(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 2, 3, 2), (3, 4, 0, 0)]
