import hashlib
import random
import re
import time

from framelake.llm.pii import digest, find_personal_data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute_force(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out)]


def random_texts():
    r = random.Random(6)
    bits = ["a", "é", "🙂", "@", ".", "-", " ", "\n", "+", "(", ")", "1", "25", "256", "0", "%", "_", "4417 7442 8035 1547", "me@x.de", "a.b@c-d.co.uk", "10.0.0.1", "+1 (017) 555-7713", "z"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(400)]


EDGE = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "00000001.2.3.255 999999999999999999999.1.1.1", "1" * 3000, "1 " * 9000, "a" * 30000 + "@x.de", "+1" + " (" * 5000 + "23456789", "x@" * 5000, "4417744280351547 me@x.de 4417744280351548", "a@b..c", "1.2.3"]


def test_base_spans_match_the_plain_patterns(spark):
    texts = [*EDGE, *random_texts()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(3)
    got = {r["doc_id"]: r for r in digest(find_personal_data(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_force(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t and t[:80], want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(w.startswith(k) for w in want) for k, _ in BASE]
        assert set(want) <= set(got[i]["spans"].split(","))


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    mail = [f"text {i} please write to p{i}@mail.org today and more text" for i in range(8)]
    unseen = ["lorem ipsum please write to AB-99817 today or so", "we counted 12345678 of them here"]
    texts = [*mail, *unseen]
    got = digest(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    spans = {r["doc_id"]: r["spans"] for r in got}
    at = unseen[0].index("AB-99817")
    assert spans[8] == f"context:{at}:{at + 8}" and spans[9] == ""
    assert all(spans[i] == f"email:{m.index(f'p{i}@')}:{m.index(f'p{i}@') + 11}" for i, m in enumerate(mail))


def test_discovered_spans_of_groups_handles_and_rows_that_share_an_id(spark):
    mail = [f"text {i} please write to p{i}@mail.org today and more text" for i in range(8)]
    cards = [f"she gave the code 4417 7442 8035 {n} to us" for n in ("1547", "1547 ", "1547  x")] + ["she gave the code 10.0.0.%d to us" % i for i in range(5)]
    hidden = [("lorem please write to (@some_handle), he said", "@some_handle"), ("now she gave the code 12 34 56 78 9 to me", "12 34 56 78 9"), ("they all please write to 7", "7")]
    rows = [(i, t) for i, t in enumerate([*mail, *cards])] + [(100, t) for t, _ in hidden] + [(100, "x" * 50_000), (None, hidden[0][0])]
    got = digest(find_personal_data(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, pattern int"))).collect()
    want = [f"context:{t.index(x)}:{t.index(x) + len(x)}" for t, x in hidden]
    assert sorted(r["spans"] for r in got if r["doc_id"] == 100) == sorted([*want, ""])
    assert [r["spans"] for r in got if r["doc_id"] is None] == [""]


def test_recall_of_planted_identifiers(spark):
    r = random.Random(4)
    words = ["stone", "river", "cloud", "paper", "garden", "window", "winter", "silver"]
    frames = ["reach me at {} before noon", "her address is {} if needed", "send it to {} or wait", "the old number {} still works"]
    rows, planted = [], {}
    for i in range(400):
        fill = lambda n: " ".join(r.choice(words) + ("" if r.random() < 0.95 else " " + str(r.randrange(999))) for _ in range(n))
        head, frame = fill(r.randrange(5, 60)) + " ", r.choice(frames)
        if i % 2:
            rows.append((i, head + frame.format(f"user{i}@mail{i % 7}.example.org") + " " + fill(9)))
        else:
            value = r.choice((f"ID-{r.randrange(10**6)}", f"{r.randrange(100, 999)} {r.randrange(100, 999)} {r.randrange(1000, 9999)}", f"@nick{i}"))
            at = len(head) + frame.index("{")
            planted[i] = f"context:{at}:{at + len(value)}"
            rows.append((i, head + frame.format(value) + " " + fill(9)))
    got = {x["doc_id"]: x["spans"].split(",") for x in digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(v in got[i] for i, v in planted.items()) >= 0.9 * len(planted)
    assert sum(s.startswith("context") for i in got for s in got[i]) <= 1.1 * len(planted)


def test_common_values_speak_against_a_pattern(spark):
    mail = [f"x{i} as of the p{i}@mail.org here" for i in range(5)]
    name = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    plain = [f"{name(i)} and {n} {name(i)} then as of the {n} there" for i in range(30) for n in range(10, 20)]
    found = [(i, t) for i, t in enumerate([*mail, *plain])]
    got = digest(find_personal_data(spark.createDataFrame(found, "doc_id long, text string"))).collect()
    assert not any("context" in x["spans"] for x in got)


def test_long_texts_take_little_more_than_linear_time(spark):
    texts = ["x" * 1_000_000, "12 ab " * 40_000, "a@b " * 20_000]
    start = time.time()
    found = digest(find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(found) == 3 and time.time() - start < 60


def test_edges_and_native(docs, texts, no_docs):
    found = find_personal_data(docs)
    assert found.count() == len(texts)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    assert digest(find_personal_data(no_docs)).collect() == []
