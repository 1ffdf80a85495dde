import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from framelake.llm import graph
from framelake.llm.importance import resample


def features(text, grams):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def brute_force(docs, target, grams=1, buckets=10_000, seed=2024, least_words=20, percent=10):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t, grams)[1])
    t = Counter(place(f) for x in target for f in features(x, grams)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    rows = []
    for doc_id, text in docs:
        n, found = features(text, grams)
        weight = sum(gain[place(f)] for f in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, len(found), weight, score, n])
    able = sorted((x for x in rows if x[4] >= least_words and x[0] is not None), key=lambda x: (-x[3], x[0]))
    out = [(*x[:4], r if r <= percent * len(able) // 100 else None) for r, x in enumerate(able, 1)]
    return sorted(map(str, out + [(*x[:4], None) for x in rows if not (x[4] >= least_words and x[0] is not None)]))


def several(seed, n=300):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(("the", "of", "Été", "ÉTÉ", "x1")) if r.random() < 0.5 else f"w{r.randrange(300)}" for _ in range(r.randrange(60)))
    docs = [(i, text()) for i in range(n)]
    docs += [(1000 + i, docs[7][1] + " so a copy of it " * 4) for i in range(60)] + [(5, docs[9][1]), docs[11], docs[11], (None, docs[30][1] + " more" * 30), (2000, None), (2001, " - "), (2002, "a b " * 20_000)]
    return docs, [text() for _ in range(20)] + [None, "", "w1 w2 w3"]


def frames(spark, docs, target):
    d = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, rank int, range int, bucket int").repartition(3)
    return d, spark.createDataFrame([(x, 4) for x in target], "text string, doc_id int")


@pytest.mark.parametrize("options", [{}, {"grams": 3, "buckets": 50, "seed": 7, "least_words": 5, "percent": 33}, {"percent": 100}, {"percent": 0}])
def test_matches_brute_force(spark, options):
    docs, target = several(3)
    got = resample(*frames(spark, docs, target), **options)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_force(docs, target, **options)


def test_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY", 20)
    docs, target = several(4, 100)
    assert sorted(str(tuple(r)) for r in resample(*frames(spark, docs, target)).collect()) == brute_force(docs, target)


def test_empty_tables(spark):
    docs, target = several(5, 40)
    d, t = frames(spark, docs, target)
    assert resample(d.limit(0), t).collect() == []
    assert sorted(str(tuple(r)) for r in resample(d, t.limit(0)).collect()) == brute_force(docs, [])


def test_runs_agree(spark):
    d, t = frames(spark, *several(6, 80))
    assert sorted(map(str, resample(d, t).collect())) == sorted(map(str, resample(d.repartition(7), t).collect()))


def test_sample_moves_towards_target(spark):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(("target", "aim", "goal") if i % 2 else ("other", "rest", "else")) for _ in range(25))) for i in range(400)]
    got = resample(*frames(spark, docs, ["target aim goal " * 20])).where("rank is not null").collect()
    assert len(got) == 40 and sum(x["doc_id"] % 2 for x in got) >= 38
