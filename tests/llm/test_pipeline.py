import random

import pytest
from test_decontaminate import brute_force as leaks
from test_line_dedup import brute_force as kept_lines
from test_minhash import brute_force as components
from test_mixing import expected

import corpus_pipeline
from framelake.llm.common import text_key
from framelake.llm.langid import identify

ITEMS = [(1, "erha thou onion inhaand reing edion thing onou"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]


@pytest.fixture(scope="module")
def sf_dir(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    more = [(901, "before it " + ITEMS[1][1].upper() + " after it and more words follow here", "en", "s1"), (902, "99 ++ 77", None, "s1")]
    r = random.Random(1)
    french = [(2000 + i, " ".join(r.choice(("élo", "ûvou", "çaqu", "guê", "lœk", "jyv")) for _ in range(60)), "fr", "s2") for i in range(20)]
    unclear = [(3000, "ЖЩЪЫЭЮЯ " * 12, None, "s1"), (3001, "ЖЩЪЫ", None, "s1"), (2001, "a text of its own under an id that another row has " * 3, None, "s2"), (None, french[0][1], "fr", None), (None, None, None, None)]
    rows = [*[(d, t, "en", s) for d, t, _, s in texts], *more, *french, *unclear]
    spark.createDataFrame([(*t, len(t[1] or "")) for t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_every_stage_against_brute_force_on_its_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    before = plain(docs)

    long = docs.where("length(text) >= 40")
    lead = {(r["doc_id"], r["key"]): r["score"] for r in identify(long).collect()}
    unclear = {(r["doc_id"], r["text"]) for r in long.withColumn("key", text_key(long.text)).collect() if r["doc_id"] is not None and lead[r["doc_id"], r["key"]] < 0.05}
    docs = stages["language_id"](spark, docs, sf_dir).cache()
    after = plain(docs)
    assert docs.columns == columns and sorted(map(str, after)) == sorted(str(r) for r in before if any(c.isalpha() for c in r[1] or "") and (r[0], r[1]) not in unclear)
    ids = [r[0] for r in after]
    assert not {902, 3000} & set(ids) and {901, 3001} < set(ids) and ids.count(2001) == 2 and ids.count(None) == 1

    before, docs = after, stages["line_dedup"](spark, docs, sf_dir).cache()
    after = plain(docs)
    want = kept_lines([b for b in before if b[0] not in (None, 2001)])
    assert docs.columns == columns and len(after) == len(before) and all(want.get(d, t) == t for d, t, *_ in after)
    assert sorted(t for d, t, *_ in after if d in (None, 2001)) == sorted(t for d, t, *_ in before if d in (None, 2001))
    assert docs.where("n_chars <> length(text)").count() == 0

    before, docs = after, stages["near_dedup"](spark, docs, sf_dir).cache()
    after = plain(docs)
    want = components([b for b in before if b[0] not in (None, 2001)])
    assert docs.columns == columns and sorted(map(str, after)) == sorted(str(b) for b in before if b[0] in (None, 2001) or want[b[0]][2])

    before, docs = after, stages["decontamination"](spark, docs, sf_dir).cache()
    after = plain(docs)
    bad = {x[0] for x in leaks(before, ITEMS)}
    assert 901 in bad and docs.columns == columns and sorted(map(str, after)) == sorted(str(b) for b in before if b[0] not in bad)

    mixed = stages["mixing"](spark, docs, sf_dir).collect()
    _, sums, targets = expected([(i, *r[1:]) for i, r in enumerate(after)])
    assert sorted((str(r["doc_id"]), r["size"]) for r in mixed) == sorted((str(r[0]), len((r[1] or "").split())) for r in after)
    taken, largest = {}, max(r["size"] for r in mixed)
    for r in mixed:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest


def test_no_rows_and_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.selectExpr("*", "1 as key", "2 as gone", "3 as bad_id", "4 as n_lines_in_", "5 as rep", "6 as h")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        got = stage(spark, more, sf_dir)
        assert got.count() > 20 and (name == "mixing" or got.columns == more.columns)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(got.columns) and got.count() > 20
