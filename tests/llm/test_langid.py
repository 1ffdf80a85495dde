import random

import pytest

from framelake.llm import langid
from framelake.llm.langid import BLOCK, Model, automaton, identify


def test_automaton_holds_exactly_the_substrings():
    r = random.Random(3)
    text = [r.randrange(3) for _ in range(60)]
    table = {(s, c): t for s, c, t in zip(*(x.tolist() for x in automaton(text)), strict=True)}

    def accepts(word):
        s = 0
        for c in word:
            s = table.get((s, c), -1)
            if s < 0:
                return False
        return True

    substrings = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(i + 7, 61))}
    for _ in range(2000):
        word = tuple(r.randrange(3) for _ in range(r.randrange(1, 7)))
        assert accepts(word) == (word in substrings)


@pytest.mark.parametrize("dense", [langid.DENSE, 0, 3000])
def test_phrases_match_a_plain_parse(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    model = Model({"x": ["the cat sat on the mat"], "y": ["der hund und die katze"]})
    texts = ["the mat sat", "und die hundkatze!" * 200, "", "q"]
    counts, sizes, letters = model.phrases(texts)
    for i, text in enumerate(texts):
        for j, source in enumerate(("the cat sat on the mat", "der hund und die katze")):
            n = 0
            for b in range(0, len(text), BLOCK):
                block, at = text[b : b + BLOCK], 0
                while at < len(block):
                    end = at + 1
                    while end < len(block) and block[at : end + 1] in source:
                        end += 1
                    n += 1
                    at = end
            assert counts[i, j] == n
    assert sizes.tolist() == [len(t) for t in texts] and letters.tolist() == [True, True, False, True]


def test_held_out_accuracy(spark):
    sample = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(sample).join(sample.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    tested = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(tested) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(docs, texts, no_docs):
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    by_id = {t[0]: t[1] for t in texts}
    for d, r in got.items():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in by_id[d] or ""))
    assert identify(docs).count() == len(texts)
    assert identify(no_docs).collect() == []


def test_labels_are_no_input(docs):
    from pyspark.sql import functions as F

    from framelake.llm.langid import train

    model = train(docs.select("doc_id", "text", "lang"))
    a = {(r["doc_id"], r["lang_pred"], r["score"]) for r in identify(docs, model).collect()}
    b = {(r["doc_id"], r["lang_pred"], r["score"]) for r in identify(docs.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_scripts_of_many_characters_and_many_labels(spark):
    r = random.Random(2)
    scripts = {"zh": range(0x4E00, 0x4E00 + 900), "zh2": range(0x4E00 + 300, 0x4E00 + 1200), "ko": range(0xAC00, 0xAC00 + 900), "th": range(0xE01, 0xE2F), "el": range(0x3B1, 0x3CA)}
    words = {k: ["".join(chr(r.choice(v)) for _ in range(r.randrange(1, 5))) for _ in range(300)] for k, v in scripts.items()}
    words |= {f"l{i}": ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 7))) for _ in range(40)] for i in range(70)}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(sorted(words) * 12)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    truth = {d: k for d, _, k in rows}
    tested = [x for x in got if x["held_out"]]
    assert len(tested) > 100 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in tested) / len(tested) > 0.97
