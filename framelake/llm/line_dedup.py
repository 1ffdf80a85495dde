"""Line dedup by pairwise alignment.

Documents that share a block are found through hashes of runs: the shortest runs of adjacent lines with BLOCK
bytes that begin or end at each line. Each run points to the earliest document that holds it, so a run in k
documents makes k - 1 pairs, however large k is. Every line of a block that two documents share lies in such a
run within the block, so the later one meets a document that holds that run. The two line sequences are aligned with patience
diff (lines unique on both sides, their longest rising run, then the same within the gaps; in gaps without such
lines the heaviest common block, then the same on both sides of it), and common blocks with enough text are deleted
from the later document: the aligned ones, and those that an alignment leaves because they stand in another order or
more often than in the earlier document. So every block of lines of BLOCK bytes or more that any earlier document
holds goes. Blocks are judged on the input, not on what another pair leaves.

Lines are compared without white space at both ends. Null text: no lines, stays null. Empty text: one empty
line, stays. A document all of whose lines go keeps its row with an empty text. Rows that share a doc_id
are never deduplicated against each other, and each loses only lines of its own text; where two of them hold
a run first, the text with the lesser key is the earlier one. A null doc_id is left alone. Texts count whole,
however long; work is dealt out by lines. Extra columns stay, whatever they are called. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import kernels as K
from .common import own_name, slices, text_key, tune, write_table
from .graph import look_up

#: Bytes that a deleted block has at least.
BLOCK = 60
#: Later documents, and lines of them, in a group of alignments.
FAN, LINES = 1000, 1_000_000


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and lengths of all lines of each text."""
    for batch in slices(batches, "text"):
        data, offsets = K.text_bytes(batch.column("text"))
        null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        feed = np.flatnonzero(data == 10)
        doc_of_feed = np.searchsorted(offsets, feed, side="right") - 1
        count = np.where(null, 0, 1 + np.bincount(doc_of_feed, minlength=batch.num_rows))
        border = np.concatenate([[0], np.cumsum(count)])
        owner = np.repeat(np.arange(batch.num_rows), count)
        nth = np.arange(len(owner)) - border[:-1][owner]
        before = np.searchsorted(feed, offsets[:-1])
        start = np.where(nth == 0, offsets[:-1][owner], np.append(feed, 0)[np.minimum(before[owner] + nth - 1, len(feed))] + 1)
        last = nth == count[owner] - 1
        end = np.where(last, offsets[1:][owner], np.append(feed, 0)[np.minimum(before[owner] + nth, len(feed))])
        solid = np.flatnonzero(~K.SPACE[data])
        lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = hi > lo
        start = np.where(some, np.append(solid, 0)[np.minimum(lo, len(solid))], start)
        end = np.where(some, np.append(solid, 0)[np.maximum(hi - 1, 0)] + 1, start)
        hashes = K.span_hash(*K.prefix_hash(data), start, end)
        lists = [pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(x)) for x in (hashes.view(np.int64), (end - start).astype(np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *lists], names=["doc_id", "key", "lines", "sizes"])


#: Base of the hashes of runs (odd, so it has an inverse modulo 2 ** 64) and the factors that mix line hashes.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def runs(lines: np.ndarray, sizes: np.ndarray, border: np.ndarray, least: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the shortest runs of ``least`` bytes that begin or end at a line of each document."""
    n = len(lines)
    owner = np.repeat(np.arange(len(border) - 1), np.diff(border))
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    begin, stop = np.arange(n), np.searchsorted(before, before[:-1] + least, side="left")
    back = np.searchsorted(before, before[1:] - least, side="right") - 1
    ahead, behind = stop <= border[1:][owner], back >= border[:-1][owner]
    begin, stop, owner = np.concatenate([begin[ahead], back[behind]]), np.concatenate([stop[ahead], begin[behind] + 1]), np.concatenate([owner[ahead], owner[behind]])
    h = lines.view(np.uint64) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(n, BASE, np.uint64)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([one, np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    found = (total[stop] - total[begin]) * inverse[begin]
    found = (found ^ (found >> np.uint64(31))) * MIX + (stop - begin).astype(np.uint64)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, sizes = batch.column("lines"), batch.column("sizes")
        border = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy())])
        owner, found = runs(lines.flatten().to_numpy(), sizes.flatten().to_numpy(), border)
        owner = pa.array(owner)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("key").take(owner), pa.array(found.view(np.int64))], names=["doc_id", "key", "run"])


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Longest rising run of lines that occur once on both sides."""
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {h: i for i, h in enumerate(a[a0:a1], a0) if ca[h] == 1 and cb.get(h) == 1}
    tails: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    top: list[int] = []
    for j in range(b0, b1):
        i = at.get(b[j])
        if i is None:
            continue
        k = bisect_left(tails, i)
        nodes.append((i, j, top[k - 1] if k else -1))
        if k == len(tails):
            tails.append(i)
            top.append(len(nodes) - 1)
        else:
            tails[k], top[k] = i, len(nodes) - 1
    out, n = [], top[-1] if top else -1
    while n >= 0:
        i, j, n = nodes[n]
        out.append((i, j))
    return out[::-1]


def _automaton(a: list[int], a0: int, a1: int) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Suffix automaton of a range: steps, suffix links, longest lengths, and a place behind each state's lines."""
    follow: list[dict[int, int]] = [{}]
    link, length, end, last = [-1], [0], [a0], 0
    for i in range(a0, a1):
        c, cur, p = a[i], len(follow), last
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(i + 1)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return follow, link, length, end


def _heaviest(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, before: list[int]) -> tuple[int, int, int, int]:
    """The heaviest block common to both ranges, (weight, place in a, place in b, lines), by a suffix automaton of a."""
    follow, link, length, end = _automaton(a, a0, a1)
    best, state, n = (0, a0, b0, 0), 0, 0
    for j in range(b0, b1):
        while state and b[j] not in follow[state]:
            state = link[state]
            n = length[state]
        if b[j] in follow[state]:
            state, n = follow[state][b[j]], n + 1
        weight = before[j + 1] - before[j + 1 - n]
        if weight > best[0]:
            best = (weight, end[state] - n, j + 1 - n, n)
    return best


def patience(a: list[int], b: list[int], sizes: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff, rising on both sides.

    Gaps without lines unique on both sides are matched by their heaviest common blocks of at least ``least``;
    ``sizes`` are the weights of ``b``, 1 each by default.
    """
    before = [0, *accumulate([1] * len(b) if sizes is None else sizes)]
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        found = _anchors(a, b, a0, a1, b0, b1)
        if not found:
            both = set(a[a0:a1]).intersection(b[b0:b1])
            if sum(before[j + 1] - before[j] for j in range(b0, b1) if b[j] in both) < least:
                continue
            weight, i, j, n = _heaviest(a, b, a0, a1, b0, b1, before)
            if weight >= least:
                out += [(i + k, j + k) for k in range(n)]
                work += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
            continue
        i0, j0 = a0, b0
        for i, j in [*found, (a1, b1)]:
            work.append((i0, i, j0, j))
            i0, j0 = i, j
            if i < a1:
                out.append((i, j))
                i0, j0 = i + 1, j + 1
    return sorted(out)


def _covered(automaton: tuple[list[dict[int, int]], list[int], list[int]], later: list[int], before: list[int], least: int) -> list[int]:
    """Lines of ``later`` within any block of at least ``least`` that the automaton's sequence holds too."""
    follow, link, length = automaton
    cut = [0] * (len(later) + 1)
    state, n = 0, 0
    for j, line in enumerate(later):
        while state and line not in follow[state]:
            state = link[state]
            n = length[state]
        if line in follow[state]:
            state, n = follow[state][line], n + 1
        if n and before[j + 1] - before[j + 1 - n] >= least:
            cut[j + 1 - n] += 1
            cut[j + 1] -= 1
    return [j for j, depth in enumerate(accumulate(cut[:-1])) if depth]


def common_blocks(earlier: list[int], later: list[int], sizes: list[int], least: int = BLOCK, held: dict | None = None) -> list[int]:
    """Lines of the later sequence within blocks of at least ``least`` bytes that the earlier one holds.

    Patience diff aligns both. Blocks in another order than the aligned ones, and those that stand in the later sequence
    more often, are not aligned; where lines could be left of such blocks, they are found by a suffix automaton of the
    earlier sequence. ``held`` keeps what depends on the earlier sequence only.
    """
    out: set[int] = set()
    block: list[int] = []
    previous = (-2, -2)
    for i, j in [*patience(earlier, later, sizes, least), (-9, -9)]:
        if block and (i, j) != (previous[0] + 1, previous[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out.update(block)
            block = []
        block.append(j)
        previous = (i, j)
    held = {} if held is None else held
    if "lines" not in held:
        held["lines"] = set(earlier)
    known = held["lines"]
    weight, left = 0, False
    for j, line in enumerate([*later, None]):
        if line in known:
            weight, left = weight + sizes[j], left or j not in out
            continue
        if left and weight >= least:
            if "automaton" not in held:
                held["automaton"] = _automaton(earlier, 0, len(earlier))[:3]
            return sorted(out.union(_covered(held["automaton"], later, [0, *accumulate(sizes)], least)))
        weight, left = 0, False
    return sorted(out)


def _align(table: pa.Table) -> pa.Table:
    """Lines to delete from each later document; the earlier ones (doc_id null) stand in the group once each."""
    earlier, later = (table.filter(x) for x in (table.column("doc_id").is_null(), table.column("doc_id").is_valid()))
    line_lists = dict(zip(zip(*(earlier.column(c).to_pylist() for c in ("earliest", "earliest_key")), strict=True), earlier.column("lines"), strict=True))
    doc_id, key, gone, held, kept = [], [], [], (None, []), {}
    order = later.sort_by([("earliest", "ascending"), ("earliest_key", "ascending")])
    for d, k, e, ek, lines, sizes in zip(*(order.column(c) for c in ("doc_id", "key", "earliest", "earliest_key", "lines", "sizes")), strict=True):
        name = (e.as_py(), ek.as_py())
        if held[0] != name:
            held, kept = (name, line_lists[name].as_py()), {}
        found = common_blocks(held[1], lines.as_py(), sizes.as_py(), held=kept)
        if found:
            doc_id.append(d.as_py())
            key.append(k.as_py())
            gone.append(found)
    return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "key": pa.array(key, pa.int64()), "gone": pa.array(gone, pa.list_(pa.int32()))})


@F.pandas_udf(StringType())
def _without(text, gone):  # noqa: ANN001, ANN202
    return text.combine(gone, lambda t, g: None if t is None or g is None else _kept(t, set(g)))


def _kept(text: str, gone: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _shared_runs(known: DataFrame) -> DataFrame:
    """Rows with the earliest holder of each of their runs: doc_id, key, earliest, earliest_key."""
    held = write_table(known.mapInArrow(_runs, "doc_id long, key long, run long"), "runs")
    first = held.groupBy("run").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.max("doc_id").alias("latest")).where("first.doc_id < latest").select("run", "first")
    met = look_up(held, "run", write_table(first, "first"), held.count(), "first").where("doc_id > first.doc_id")
    return met.select("doc_id", "key", F.col("first.doc_id").alias("earliest"), F.col("first.key").alias("earliest_key"))


def remove_common_blocks(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the new ``text``, and before them n_lines_in_ and n_lines_out_ (long).

    Where ``docs`` has columns of these names, the new ones get one more underscore.
    """
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    known = write_table(texts.where("doc_id is not null").mapInArrow(_lines, "doc_id long, key long, lines array<long>, sizes array<int>"), "lines")
    pairs = write_table(_shared_runs(known.select("doc_id", "key", "lines", "sizes")).distinct(), "pairs")

    # An earlier document of many pairs or long partners stands in several copies, so no group grows with the corpus.
    one = known.dropDuplicates(["doc_id", "key"])
    load = F.lit(1.0 / FAN) + F.size("lines") / F.lit(float(LINES))
    later = pairs.join(one, ["doc_id", "key"]).withColumn("load", load)
    copies = write_table(pairs.join(one.select("doc_id", "key", load.alias("load")), ["doc_id", "key"]).groupBy("earliest", "earliest_key").agg(F.ceil(F.sum("load")).cast("int").alias("copies"), F.sum("load").alias("load")), "copies")
    groups = max(1, math.ceil(copies.agg(F.sum("load")).first()[0] or 0))
    group = F.pmod(F.xxhash64("earliest", "earliest_key", "copy"), F.lit(groups)).alias("g")
    earlier = copies.join(one.select(F.col("doc_id").alias("earliest"), F.col("key").alias("earliest_key"), "lines"), ["earliest", "earliest_key"])
    earlier = earlier.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(group, "earliest", "earliest_key", "lines").distinct()
    dealt = later.join(copies.drop("load"), ["earliest", "earliest_key"]).withColumn("copy", F.pmod(F.xxhash64("doc_id", "key"), F.col("copies")).cast("int"))
    dealt = dealt.select(group, "doc_id", "key", "earliest", "earliest_key", "lines", "sizes")
    earlier = earlier.select("g", F.lit(None).cast("long"), F.lit(None).cast("long"), "earliest", "earliest_key", "lines", F.lit(None).cast("array<int>"))
    aligned = dealt.union(earlier).groupBy("g").applyInArrow(_align, "doc_id long, key long, gone array<int>")
    id_, key_, gone_ = (own_name(docs.columns, x) for x in ("gone_id", "gone_key", "gone"))
    gone = write_table(aligned.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")).toDF(id_, key_, gone_), "gone")

    # Never broadcast: the table grows with the corpus.
    joined = docs.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col(id_)) & (text_key(F.col("text")) == F.col(key_)), "left")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    new = F.when(F.col(gone_).isNotNull(), _without(F.when(F.col(gone_).isNotNull(), F.col("text")), gone_)).otherwise(F.col("text"))
    kept = [new.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    names = [own_name(docs.columns, x) for x in ("n_lines_in_", "n_lines_out_")]
    return joined.select(lines.alias(names[0]), (lines - F.coalesce(F.size(gone_), F.lit(0))).alias(names[1]), *kept)
