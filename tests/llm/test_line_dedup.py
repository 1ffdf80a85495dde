import difflib
import random

import numpy as np

from framelake.llm import line_dedup
from framelake.llm.line_dedup import common_blocks, patience, remove_common_blocks


def test_patience_matches_rise_and_are_equal():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randrange(12) for _ in range(r.randrange(25))]
        b = [r.randrange(12) for _ in range(r.randrange(25))]
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    a = list(range(50))
    b = [*range(5), 99, *range(9, 30), 98, *range(30, 50)]
    want = [(m.a + k, m.b + k) for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks() for k in range(m.size)]
    assert patience(a, b) == want


def lines_of(text):
    return None if text is None else text.split("\n")


def held_by_earlier(lines, sizes, earlier):
    """Lines within a block of BLOCK bytes that one of the ``earlier`` line lists holds."""
    gone = set()
    for s in range(len(lines)):
        for e in range(s + 1, len(lines) + 1):
            block = lines[s:e]
            if sum(sizes[s:e]) >= line_dedup.BLOCK and any(block == x[i : i + e - s] for x in earlier for i in range(len(x) - e + s + 1)):
                gone |= set(range(s, e))
    return gone


def brute_force(rows):
    """Every document beside all earlier ones, block by block, without hashes or alignment."""
    out = {}
    parsed = {d: [x.strip(" \t\n\x0b\x0c\r") for x in lines_of(t) or []] for d, t, *_ in rows}
    for d, t, *_ in rows:
        gone = held_by_earlier(parsed[d], [len(x.encode()) for x in parsed[d]], [parsed[e] for e in parsed if e < d])
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(lines_of(t)) if i not in gone)
    return out


def test_matches_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(r.randrange(2, 12))) + str(i) for i in range(60)]
    rows = []
    for i in range(50):
        lines = [r.choice(pool) if r.random() < 0.5 else f"  own line {i} {k} with some length {r.random()} " for k in range(r.randrange(12))]
        if i % 3 == 0:
            at = r.randrange(40)
            lines += pool[at : at + 6] + ["", "short"]
        rows.append((i * 17 % 101, "\n".join(lines), "x", None))
    rows += [(300, None, "x", None), (301, "", "x", None), (302, "\n\n", "x", None), (303, rows[0][1], None, "é"), (304, "one very long line " * 2000, "x", None), (305, "one very long line " * 2000, "x", None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, source string, lines int").repartition(3)
    got = remove_common_blocks(df).collect()
    want = brute_force(rows)
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "lang", "source", "lines"}
    for x in got:
        assert x["text"] == want[x["doc_id"]], x["doc_id"]
        assert x["n_lines_out_"] == (0 if x["text"] is None else x["n_lines_out_"])
    assert sum(want[d] != t for d, t, *_ in rows) > 15


def test_edges(docs, texts, no_docs):
    got = remove_common_blocks(docs).collect()
    assert len(got) == len(texts)
    assert remove_common_blocks(no_docs).collect() == []


def text_column(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    return [x["text"] for x in sorted(remove_common_blocks(df).collect(), key=lambda x: x["doc_id"])]


def test_rows_that_share_an_id_and_clashing_names(spark):
    block = [f"line {k} of a block that two documents share" for k in range(3)]
    rows = [(1, "\n".join(["a", *block])), (2, "\n".join(["b", *block, "c"])), (2, "an unrelated text\nof two lines, and a third one\nwhich stays as it is"), (2, "\n".join(["b", *block, "c"])), (None, "\n".join(block)), (3, "\n".join([*block, "d"])), (3, "x\n" + "\n".join(block))]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, 6) for x in rows], "doc_id long, text string, gone int, gone_ int, gone_id int, key int, n_lines_in_ int, earliest int").repartition(3)
    got = remove_common_blocks(df)
    assert got.columns[:2] == ["n_lines_in__", "n_lines_out_"] and got.columns[2:] == df.columns
    assert sorted((str(x["doc_id"]), x["text"]) for x in got.collect()) == sorted([("1", rows[0][1]), ("2", "b\nc"), ("2", "b\nc"), ("2", rows[2][1]), ("None", rows[4][1]), ("3", "d"), ("3", "x")])


def test_a_passage_in_many_documents_goes_from_all_but_the_first(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FAN", 7)
    passage = [f"line {k} of a passage that many documents hold" for k in range(5)]
    own = [[f"own line {k} of document {i}, at some length" for k in range(20)] for i in range(60)]
    got = text_column(spark, ["\n".join([*x[:9], *passage, *x[9:]]) for x in own])
    assert got == ["\n".join([*own[0][:9], *passage, *own[0][9:]]), *("\n".join(x) for x in own[1:])]


def test_stray_holders_of_single_lines_hide_no_block(spark):
    a, b, c = (f"{x * 4} one of the three lines of a block" for x in "ABC")
    rows = ["\n".join(x) for x in (["x", a, "y", b, "z", c], ["q", a, b, c], ["r", a, b, c])]
    assert text_column(spark, rows) == [rows[0], rows[1], "r"]


def test_runs_cover_every_line_of_every_common_block():
    r = random.Random(5)
    for _ in range(200):
        sizes = np.array([r.choice((0, 5, 20, 35, 70)) for _ in range(r.randrange(1, 12))])
        lines = np.array([r.randrange(1 << 40) for _ in sizes], np.int64)
        whole = set(line_dedup.runs(lines, sizes, np.array([0, len(lines)]))[1].tolist())
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                part = line_dedup.runs(lines[s:e], sizes[s:e], np.array([0, e - s]))[1].tolist()
                assert set(part) <= whole and bool(part) == (sizes[s:e].sum() >= line_dedup.BLOCK)


def test_matches_all_pairs(spark):
    r = random.Random(9)
    pool = [[f"{i} {k} " + "word " * r.randrange(12) + "." for k in range(r.randrange(2, 6))] for i in range(12)]
    rows = []
    for d in range(45):
        lines = []
        # In any order, some twice, some only in part, some without a line of the document between them.
        for i in r.choices(range(12), k=r.randrange(6)):
            part = [x.strip() for x in pool[i]][r.choice((0, 0, 1)) :]
            lines += [f"own {d} {i}", *part] if r.random() < 0.7 else part
        rows.append("\n".join([*lines, f"end {d}"]))
    want = [x for _, x in sorted(brute_force(list(enumerate(rows))).items())]
    assert text_column(spark, rows) == want and sum(x != y for x, y in zip(rows, want, strict=True)) > 15


def test_short_lines_and_repeated_passages(spark):
    verse = [f"short line {k}" for k in range(9)]
    rows = ["\n".join(x) for x in (["x", *verse, "y"], ["p", *verse, "q"], ["u", *verse, "v", *verse, "w"])]
    assert text_column(spark, rows) == [rows[0], "p\nq", "u\nv\nw"]


def test_blocks_in_another_order(spark):
    x, y = ("a block of one line that is long enough to count, number " + n for n in ("one", "two"))
    assert text_column(spark, [f"{y}\n{x}", x, f"{x}\n{y}", f"{x}\nmine\n{y}\n{x}"]) == [f"{y}\n{x}", "", "", "mine"]


def test_blocks_match_brute_force_on_random_sequences():
    r = random.Random(11)
    for _ in range(400):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 14))] for _ in range(2))
        size = {k: r.choice((0, 20, 40, 70)) for k in range(6)}
        sizes = [size[k] for k in b]
        assert set(common_blocks(a, b, sizes)) == held_by_earlier(b, sizes, [a])


def test_heaviest_block_of_gaps_without_unique_lines():
    r = random.Random(6)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 15))] for _ in range(2))
        before = [0, *np.cumsum([r.randrange(1, 9) for _ in b]).tolist()]
        want = max(before[e] - before[s] for s in range(len(b)) for e in range(s, len(b) + 1) if any(a[i : i + e - s] == b[s:e] for i in range(len(a))))
        weight, i, j, n = line_dedup._heaviest(a, b, 0, len(a), 0, len(b), before)
        assert weight == want == before[j + n] - before[j] and a[i : i + n] == b[j : j + n]
