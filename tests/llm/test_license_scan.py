import random
import re

import pytest

from framelake.llm import license_scan
from framelake.llm.license_scan import PHRASES, TEMPLATES, digest, scan_licenses, template_words


def brute_force(text, templates=TEMPLATES, phrases=PHRASES, threshold=0.75):
    """Every block of every length beside every template, by plain counting."""
    words = template_words(text)
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = set()
    for t, (label, written) in enumerate(templates):
        want = template_words(written)
        step = 1
        while step < len(want):
            step *= 2
        for b in range(0, len(words), step):
            if want:
                n = len(set(want) & set(words[b : b + 2 * step]))
                if n >= threshold * len(set(want)):
                    found.add((t, label, b, n))
    share = [n / len(set(template_words(templates[t][1]))) for t, _, _, n in found]
    base = sorted({label for _, label in places})
    return found, (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, base,
        sorted({*base, *(label for _, label, _, _ in found)}), 1.0 if places else max(share, default=0.0),
    )


def check(spark, rows, templates=TEMPLATES, **more):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_words int, label string, spaced int").repartition(3)
    documents, blocks = scan_licenses(docs, templates, **more)
    want = [(i, *brute_force(t, templates, **more)) for i, t in rows]
    got = [(r["doc_id"], (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])) for r in documents.collect()]
    assert sorted(map(str, got)) == sorted(str((i, d)) for i, _, d in want)
    found = {(r["doc_id"], r["template"], r["label"], r["first_word"], r["n_found"]) for r in blocks.collect()}
    assert found == {(i, *f) for i, fs, _ in want for f in fs}
    return got, found


def wrapped(text, seed):
    """``text`` with other separators and letter cases."""
    r = random.Random(seed)
    return "".join(r.choice(("\n# ", " ", " - ")) if c == " " else c.upper() if r.random() < 0.2 else c for c in text)


def test_matches_brute_force(spark, texts):
    r = random.Random(1)
    rows = [(i, t) for i, t, *_ in texts]
    for n, (_, notice) in enumerate(TEMPLATES):
        words = notice.split()
        fewer = [w for w in words if r.random() < 0.8]
        mixed = words[:]
        r.shuffle(mixed)
        filler = " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(40)))
        for k, t in enumerate((notice, wrapped(notice, n), filler + "\n" + wrapped(notice, n) + "\n" + filler * 3, " ".join(fewer), " ".join(mixed), " ".join(words[: len(words) // 2]))):
            rows.append((5000 + 10 * n + k, t))
    rows += [(9000, "the " * 5000 + TEMPLATES[1][1] + " of" * 4000), (9001, "License license " * 30), (9000, "MIT License mit license"), (None, "CC BY CC BY by cc"), (None, None)]
    got, found = check(spark, rows + rows[:2])
    assert {f[2] for f in found} == {label for label, _ in TEMPLATES} and len(got) == len(rows) + 2


def test_base_places():
    assert brute_force("Apache\n\nLicense, apache license")[1][:5] == (4, 2, 0, 2, ["apache"])


def test_phrases_that_overlap_themselves(spark):
    phrases = {"a b a": "x", "b": "y"}
    check(spark, [(1, "a b a b a"), (2, "a  b"), (3, "ab a b. A!"), (4, "b")], phrases=phrases)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_thresholds_on_random_words(spark, threshold):
    r = random.Random(7)
    words = [chr(97 + k) * n for k in range(8) for n in (1, 2)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    templates = [(f"t{k}", text(n)) for k, n in enumerate((1, 2, 3, 5, 8, 9, 20))] + [("null", None), ("none", "--"), ("t3", "a a a bb")]
    check(spark, [(i, text(r.randrange(60))) for i in range(40)], templates, threshold=threshold)


def test_empty_tables_and_lists(spark, no_docs):
    documents, blocks = scan_licenses(no_docs)
    assert documents.collect() == [] and blocks.collect() == []
    check(spark, [(1, "MIT License"), (2, None)], [])
    check(spark, [(1, "MIT License"), (2, None)], phrases={})


def test_too_many_words_of_templates(spark, no_docs, monkeypatch):
    monkeypatch.setattr(license_scan, "TEMPLATE_WORDS", 3)
    with pytest.raises(ValueError, match="distinct words"):
        scan_licenses(no_docs)


def test_digest_and_native_plan(spark, docs):
    documents, _ = scan_licenses(docs)
    out = digest(documents)
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
