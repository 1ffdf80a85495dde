import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import kernels as K
from framelake.llm import suffix_dedup


def brute_force(rows, length=50):
    data = {d: (t or "").encode() for d, t, *_ in rows}
    least = {}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            least.setdefault(data[d][i : i + length], d)
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = True
        flags = gone[: len(b)]
        spans = int((flags & ~np.concatenate([[False], flags[:-1]])[: len(b)]).sum())
        out[d] = (len(b), int(flags.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, flags, strict=True) if not g)).hexdigest())
    return out


def check(df, rows):
    got = suffix_dedup.remove_repeats(df).collect()
    want = brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    return want


def test_fixture(docs, texts):
    want = check(docs, texts)
    assert sum(w[1] > 0 for w in want.values()) > 20


def test_borders_of_passages(spark):
    r = random.Random(4)
    line = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [line(n) for n in (49, 50, 51, 60, 84, 85, 120, 900)]
    rows = [(i * 7 % 101, line(r.randrange(90)) + passages[i % 8] + line(r.randrange(90)) + passages[(i * 3 + 1) % 8], None, None) for i in range(60)]
    rows += [(200, "ab" * 600, None, None), (201, "ab" * 300, None, None), (150, "x" + "ab" * 40, None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4), rows)


@pytest.mark.parametrize("name, value", [("HOT", 3), ("PIECE_GROUP", 20), ("FLUSH", 50)])
def test_groups_and_hot_anchors(spark, texts, monkeypatch, name, value):
    monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_GROUP", 1000)
    common = "the same sixteen bytes of every one of these texts and some more so that it is long "
    rows = [*texts[:12], *[(1000 + i, f"{i * 977 % 1009} {i} {common} {i} {i * 31 % 997}" + "-" * (i % 5) + common[:60] * (i % 3), None, None) for i in range(40)]]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), rows)


def test_refinement_numbers_equal_strings_alike():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 700).astype(np.uint8)
    end = np.where(np.arange(700) < 350, 350, 700)
    for length in (8, 16, 23, 50):
        got = suffix_dedup.refine(data, end, length)
        raw, number = data.tobytes(), {}
        for i in range(700):
            if i + length > end[i]:
                assert got[i] == -1
            else:
                assert number.setdefault(raw[i : i + length], got[i]) == got[i]
        assert len(set(number.values())) == len(number)


def test_null_ids_and_no_rows(spark, no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []
    rows = [(None, "y" * 80), (1, "y" * 80), (2, "y" * 80)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: 0, 1: 0, 2: 80}


def test_rows_that_share_an_id(spark):
    r = random.Random(6)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (700, 90, 4000))
    rows = [(1, a), (2, "q" + a + "w"), (2, "short"), (2, c), (2, c), (2, None), (3, b + c), (3, b), (None, a), (3, "z" * 20 + a[100:180])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(*x, 1, "h") for x in rows], "doc_id long, text string, key int, runs string").repartition(3)).collect()
    want = [(d, len((t or "").encode()), n) for (d, t), n in zip(rows, [0, 700, 0, 0, 0, 0, 4000, 0, 0, 80], strict=True)]
    assert sorted(map(str, want)) == sorted(str((x["doc_id"], x["n_bytes"], x["n_removed"])) for x in got)


def test_kernels_work_in_blocks(monkeypatch):
    r = np.random.default_rng(7)
    data = r.integers(97, 101, 4000).astype(np.uint8)
    plain = suffix_dedup._grams(data)
    least = suffix_dedup._window_minima(plain)
    assert all(least[i] == plain[i : i + 31].min() for i in range(4000))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    for n in (0, 1, 7, 31, 63, 64, 65, 94, 95, 4000):
        grams = suffix_dedup._grams(data[:n])
        assert (grams[: max(n - 19, 0)] == plain[: max(n - 19, 0)]).all()
        assert suffix_dedup._window_minima(grams).tolist() == [grams[i : i + 31].min() for i in range(n)]
    # A batch of many texts is handled a block at a time, and no bytes are sent that nobody wants.
    seen, plain = [], K.text_bytes
    monkeypatch.setattr(K, "text_bytes", lambda column: seen.append(plain(column)) or seen[-1])
    n = 400
    rows = {"doc_id": pa.array(range(n)), "key": pa.array(range(n)), "text": pa.array([f"{i} " * 2000 for i in range(n)])}
    cuts = list(suffix_dedup._cut(iter([pa.record_batch(rows)])))
    assert len(seen) > 4 and max(len(x) for x, _ in seen) <= K.BLOCK and sum(x.num_rows for x in cuts) >= n
    nothing = {"runs": pa.array([None] * n, pa.list_(pa.struct([("key", pa.int64())]))), "found": pa.array([None] * n, pa.list_(pa.struct([("key", pa.int64())])))}
    for keep in (True, False):
        done = pa.Table.from_batches(list(suffix_dedup._remove(keep)(iter([pa.record_batch(rows | nothing)]))))
        assert done.num_rows == n and ("kept" in done.column_names) == keep


def test_spans_end_with_their_text():
    length = suffix_dedup.LENGTH
    struct = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
    found = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("flags", pa.list_(pa.bool_()))])
    texts = ["a" * length, "b" * length, "", "c" * 40 + "d" * (2 * length) + "e" * 40, "f" * 30]
    whole = [{"key": 1, "at": 0, "n": 1}]
    runs = [whole, whole, None, [{"key": 1, "at": 40, "n": 1}], None]
    flags = [None, None, None, [{"key": 1, "at": 40 + length - 1, "flags": [False, True, False]}, {"key": 9, "at": 0, "flags": [True]}], None]
    rows = {"doc_id": pa.array(range(5)), "key": pa.array([1] * 5), "text": pa.array(texts), "runs": pa.array(runs, pa.list_(struct)), "found": pa.array(flags, pa.list_(found))}
    (got,) = suffix_dedup._remove(True)(iter([pa.record_batch(rows)]))
    assert got.column("n_removed").to_pylist() == [length, length, 0, 2 * length, 0]
    assert got.column("n_spans").to_pylist() == [1, 1, 0, 1, 0]
    assert got.column("kept").to_pylist() == [b"", b"", b"", b"c" * 40 + b"e" * 40, b"f" * 30]
