"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document of smaller doc_id.
Sorting every suffix of the corpus would move it many times over, so suffixes are narrowed down first,
without losing any match:

1. Texts are cut where their content says so. A piece that, with the LENGTH - 1 bytes after it, is the
   same as a piece of an earlier document is settled whole (long copies end here).
2. Of every window that is left, the least GRAM-gram is its anchor. Equal windows have equal anchors, so
   windows stay only if their anchor occurs in two documents. Anchors travel packed, and an anchor met in
   two documents within one batch is sent once, so a common passage is no hot group.
3. What remains is brought together by anchor, equal strings once, and refined: the initial 8-gram buckets
   are sorted on (bucket of p, bucket of p + 8), the buckets of 16 found so on (p, p + 16), those of 32 on
   (p, p + 18). Only buckets with two members are refined, and each refinement uses the bucket numbers
   of the last one. A window goes if its final bucket has a smaller doc_id.

An anchor with more than HOT different surroundings is split: its windows are dealt out by their bytes.

Nulls, empty and short texts: nothing is removed. Rows that share a doc_id are no earlier documents to each
other, so exact repeats of a row stay, and each loses only what its own text repeats; a null doc_id is never
earlier and loses nothing. Texts count whole; very long ones are handled one at a time. Several equal earlier
documents count as one. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import slices, text_key, tune, write_table

LENGTH, GRAM = 50, 20
#: A cut at one position in so many; windows a group of anchors comes from; strings in a group of the refinement.
CUT, ANCHOR_GROUP, PIECE_GROUP, HOT = 256, 16_000_000, 40_000, 200_000
#: Bytes of text in a bucket of the scratch table, about.
BUCKET = 512 << 20
#: Anchors held by a task before they are packed; windows of one string at most.
FLUSH, RUN = 1_500_000, 64
#: Positions hashed at once, so that what comes in between stays in the cache.
CHUNK = 1 << 15


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at every position; 0-padded beyond the end."""
    raw, out = np.zeros(len(data) + GRAM, np.uint8), np.empty(len(data), np.uint64)
    raw[: len(data)] = data
    for a in range(0, len(data), CHUNK):
        x = out[a : a + CHUNK]
        eight = _eights(raw[a : a + len(x) + GRAM])
        np.add(eight[GRAM - 8 : GRAM - 8 + len(x)], K.BASE, out=x)
        K.mix_own(x)
        x += eight[8 : 8 + len(x)] * K.M3
        K.mix_own(x)
        x += eight[: len(x)] * K.M1
        K.mix_own(x)
    return out


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every position but the last seven, as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,)).astype(np.uint64)


def _window_minima(grams: np.ndarray) -> np.ndarray:
    """Least of the LENGTH - GRAM + 1 grams from every position on (shorter at the end)."""
    span, out = LENGTH - GRAM + 1, np.empty_like(grams)
    for a in range(0, len(grams), CHUNK):
        need = min(CHUNK, len(grams) - a) + span - 1
        least, width = grams[a : a + need], 1
        if len(least) < need:
            least = np.append(least, np.full(need - len(least), np.iinfo(np.uint64).max, np.uint64))
        while width < span:
            step = min(width, span - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        out[a : a + CHUNK] = least
    return out


def _starts(offsets: np.ndarray) -> np.ndarray:
    """Where a window of LENGTH bytes lies within one text."""
    out = np.ones(offsets[-1], bool)
    has = np.diff(offsets) > 0
    late = offsets[1:][has, None] - np.arange(1, LENGTH)
    out[np.maximum(late, offsets[:-1][has, None]).ravel()] = False
    return out


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column (null: none) and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    return column.flatten(), rows


def _own(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """As _flat, of a list of structs; without those that belong to another text of the same doc_id."""
    flat, rows = _flat(batch.column(name))
    if len(flat):
        mine = flat.field("key").to_numpy(zero_copy_only=False) == batch.column("key").to_numpy(zero_copy_only=False)[rows]
        if not mine.all():
            flat, rows = flat.filter(pa.array(mine)), rows[mine]
    return flat, rows


def _settled(batch: pa.RecordBatch, offsets: np.ndarray) -> np.ndarray:
    """Windows that step 1 has found in an earlier document."""
    flat, rows = _own(batch, "runs")
    if not len(flat):
        return np.zeros(offsets[-1], bool)
    change = np.zeros(offsets[-1] + 1, np.int32)
    at = offsets[rows] + flat.field("at").to_numpy(zero_copy_only=False)
    np.add.at(change, at, 1)
    np.add.at(change, at + flat.field("n").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", K.BLOCK):
        data, offsets = K.text_bytes(batch.column("text"))
        has = np.flatnonzero(np.diff(offsets) >= LENGTH)
        if not len(has):
            continue
        cut = _starts(offsets) & (_grams(data) % np.uint64(CUT) == 0)
        cut[offsets[has]] = True
        at = np.flatnonzero(cut)
        doc = np.searchsorted(offsets, at, side="right") - 1
        stop = offsets[doc + 1] - LENGTH + 1
        end = np.minimum(np.append(at[1:], offsets[-1]), stop)
        hashes = [K.span_hash(*K.prefix_hash(data, base, salt), at, end + LENGTH - 1).view(np.int64) for base, salt in ((K.BASE, 0), (K.M1, 77))]
        ids = [batch.column(c).take(pa.array(doc)) for c in ("doc_id", "key")]
        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, hashes), pa.array((at - offsets[doc]).astype(np.int32)), pa.array((end - at).astype(np.int32))], names=["doc_id", "key", "h1", "h2", "at", "n"])


def _pack(anchor: np.ndarray, doc: np.ndarray, groups: int, turn: int) -> pa.RecordBatch:
    """One row for each group: anchors to compare, and those already met in two documents here."""
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    keep = np.ones(len(anchor), bool)
    keep[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    anchor, doc = anchor[keep], doc[keep]
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, len(anchor)))
    known = np.repeat(size > 1, size)
    group = np.where(first, (anchor % np.uint64(groups)).astype(np.int64), (np.arange(len(anchor)) + turn) % groups)
    sort = np.lexsort((first, group))
    anchor, doc, group, first, known = anchor[sort], doc[sort], group[sort], first[sort], known[sort]
    rows = {"group": [], "anchors": [], "first": [], "known": [], "docs": [], "place": []}
    border = np.searchsorted(group, np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(border)):
        s = slice(border[g], border[g + 1])
        names, place = np.unique(doc[s], return_inverse=True)
        rows["group"].append(int(g))
        rows["anchors"].append(np.ascontiguousarray(anchor[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
        rows["first"].append(np.packbits(first[s]).tobytes())
        rows["known"].append(np.packbits(known[s]).tobytes())
        rows["docs"].append(names.astype("<i8").tobytes())
        rows["place"].append(place.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
    kinds = {"group": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()], names=list(rows))


def _anchors(groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, count, turn = [], [], 0, 0
        for batch in slices(batches, "text", K.BLOCK):
            data, offsets = K.text_bytes(batch.column("text"))
            open_ = _starts(offsets) & ~_settled(batch, offsets) if len(data) else np.zeros(0, bool)
            if not open_.any():
                continue
            least = _window_minima(_grams(data))
            at = np.flatnonzero(open_)
            new = np.ones(len(at), bool)
            new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
            at = at[new]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held.append(least[at] >> np.uint64(24))
            docs.append(ids[np.searchsorted(offsets, at, side="right") - 1].astype(np.int64))
            count += len(at)
            if count >= FLUSH:
                yield _pack(np.concatenate(held), np.concatenate(docs), groups, turn)
                held, docs, count, turn = [], [], 0, turn + 1
        if count:
            yield _pack(np.concatenate(held), np.concatenate(docs), groups, turn)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Anchors of a group that occur in two documents, with each of these."""
    anchor, doc, first, known = [], [], [], []
    for row in table.to_pylist():
        raw = np.zeros((len(row["anchors"]) // 5, 8), np.uint8)
        raw[:, :5] = np.frombuffer(row["anchors"], np.uint8).reshape(-1, 5)
        n = len(raw)
        anchor.append(raw.reshape(-1).view("<u8"))
        first.append(np.unpackbits(np.frombuffer(row["first"], np.uint8), count=n).astype(bool))
        known.append(np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool))
        place = np.ascontiguousarray(np.frombuffer(row["place"], np.uint8).reshape(4, n).T).reshape(-1).view("<u4")
        doc.append(np.frombuffer(row["docs"], "<i8")[place])
    anchor, doc, first, known = map(np.concatenate, (anchor, doc, first, known))
    one = np.flatnonzero(first)
    order = one[np.lexsort((doc[one], anchor[one]))]
    a, d = anchor[order], doc[order]
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(begin, len(a)))
    differ = np.repeat(np.maximum.reduceat(d, begin) > np.minimum.reduceat(d, begin), size)
    hit = known.copy()
    hit[order[differ]] = True
    return pa.table({"doc_id": doc[hit], "anchor": anchor[hit].astype(np.int64)})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of adjacent open windows that share an anchor of two documents."""
    for batch in slices(batches, "text", K.BLOCK):
        data, offsets = K.text_bytes(batch.column("text"))
        open_ = _starts(offsets) & ~_settled(batch, offsets) if len(data) else np.zeros(0, bool)
        if not open_.any():
            continue
        least = _window_minima(_grams(data))
        at = np.flatnonzero(open_)
        # Windows one after another that share an anchor, and so a text: windows of two texts are LENGTH - 1 bytes apart.
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
        begin = np.flatnonzero(new)
        first, size = at[begin], np.diff(np.append(begin, len(at)))
        doc = np.searchsorted(offsets, first, side="right") - 1
        flat, rows = _flat(batch.column("anchors"))
        wanted = np.unique(K.mix(flat.to_numpy(zero_copy_only=False).astype(np.uint64) + rows.astype(np.uint64) * K.M1))
        have = K.mix((least[first] >> np.uint64(24)) + doc.astype(np.uint64) * K.M1)
        hit = wanted[np.minimum(np.searchsorted(wanted, have), len(wanted) - 1)] == have if len(wanted) else np.zeros(len(have), bool)
        first, size, doc = first[hit], size[hit], doc[hit]
        if not len(first):
            continue
        # Strings of RUN windows at most.
        many = -(-size // RUN)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, doc = np.repeat(first, many) + nth * RUN, np.repeat(doc, many)
        end = start + np.minimum(np.repeat(size, many) - nth * RUN, RUN) + LENGTH - 1
        raw = data.tobytes()
        hashes = [K.span_hash(*K.prefix_hash(data, base, salt), start, end).view(np.int64) for base, salt in ((K.BASE, 0), (K.M1, 77))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(least[start].view(np.int64)),
                *map(pa.array, hashes),
                pa.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()),
                *(batch.column(c).take(pa.array(doc)) for c in ("doc_id", "key")),
                pa.array((start - offsets[doc]).astype(np.int32)),
            ],
            names=["anchor", "h1", "h2", "piece", "doc_id", "key", "at"],
        )


def _numbered(keys: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    out = np.full(size, -1, np.int64)
    out[where] = np.unique(keys[where], return_inverse=True)[1]
    return out


def refine(data: np.ndarray, end: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket number of the ``length`` bytes at each position, -1 where its string (ending at ``end``) is shorter.

    ``length`` is at least 8. Buckets of 8-grams are refined by the bucket numbers at later offsets.
    """
    n = len(data)
    raw = np.zeros(n + 8, np.uint8)
    raw[:n] = data
    place = np.arange(n)
    bucket, have = _numbered(_eights(raw)[:n], place + 8 <= end, n), 8
    while have < length:
        step = min(have, length - have)
        valid = np.flatnonzero(place + have + step <= end)
        size = np.bincount(bucket[bucket >= 0]) if n else np.zeros(0, np.int64)
        many = size[bucket[valid]] > 1
        finer = np.full(n, -1, np.int64)
        alone, shared = valid[~many], valid[many]
        finer[alone] = bucket[alone]
        base = len(size)
        pair = bucket[shared] * np.int64(base + 1) + bucket[shared + step]
        finer[shared] = base + np.unique(pair, return_inverse=True)[1] if len(shared) else 0
        # Numbers without gaps, in the same order.
        used = np.zeros(finer.max(initial=-1) + 2, bool)
        used[finer] = True
        used[-1] = False
        number = np.append(np.cumsum(used[:-1]) - 1, -1)
        bucket, have = number[finer], have + step
    return bucket


def _resolve(table: pa.Table) -> pa.Table:
    """For each string, the least doc_id of every window in it."""
    table = table.combine_chunks()
    data, offsets = K.text_bytes(table.column("piece").chunk(0)) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bucket = refine(data, offsets[1:][owner])
    at = np.flatnonzero(bucket >= 0)
    low = table.column("lo").to_numpy().astype(np.int64)
    least = np.full(bucket.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket[at], low[owner[at]])
    values, border = least[bucket[at]], np.searchsorted(at, offsets)
    mins = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(values))
    return pa.table({"anchor": table.column("anchor"), "h1": table.column("h1"), "h2": table.column("h2"), "mins": mins})


def _by_window(hot: DataFrame) -> DataFrame:
    """As ``_resolve``, for anchors of very many strings: windows meet by their own bytes."""
    at = F.sequence(F.lit(0), F.length("piece") - LENGTH)
    windows = hot.select("anchor", "h1", "h2", "lo", F.posexplode(F.transform(at, lambda i: F.col("piece").substr(i + 1, F.lit(LENGTH)))).alias("pos", "window"))
    least = windows.groupBy("window").agg(F.min("lo").alias("least"))
    back = windows.join(least, "window").groupBy("anchor", "h1", "h2").agg(F.sort_array(F.collect_list(F.struct("pos", "least"))).alias("all"))
    return back.select("anchor", "h1", "h2", F.col("all.least").alias("mins"))


def _remove(keep_bytes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", K.BLOCK):
            data, offsets = K.text_bytes(batch.column("text"))
            n = len(data)
            gone = np.zeros(n, bool)
            if n:
                gone |= _settled(batch, offsets)
                flat, rows = _own(batch, "found")
                if len(flat):
                    flags, nth = _flat(flat.field("flags"))
                    start = offsets[rows] + flat.field("at").to_numpy(zero_copy_only=False)
                    border = np.searchsorted(nth, np.arange(len(start)))
                    place = start[nth] + np.arange(len(nth)) - border[nth]
                    gone[place[flags.to_numpy(zero_copy_only=False).astype(bool)]] = True
            # Windows that touch within a text cover one stretch.
            at, begins = np.flatnonzero(gone), np.zeros(n + 1, bool)
            begins[offsets] = True
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] > at[:-1] + LENGTH) | begins[at[1:]]
            first, last = at[new], at[np.append(new[1:], True)[: len(at)]] + LENGTH
            doc = np.searchsorted(offsets, first, side="right") - 1
            cuts = np.searchsorted(doc, np.arange(len(offsets)))
            before = np.concatenate([[0], np.cumsum(last - first)])
            raw, kept = memoryview(data), []
            for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                edges = [a, *np.stack([first[i:j], last[i:j]], axis=1).ravel().tolist(), b] if i < j else [a, b]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(before[cuts])), "n_spans": pa.array(np.diff(cuts).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept": pa.array(kept, pa.binary())} if keep_bytes else {}))

    return run


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wished, the kept bytes of every row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    size = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Spark refuses more buckets than this setting; beyond it buckets grow instead.
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    parts = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET)))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    laid = every.where("doc_id is not null").repartition(parts, "doc_id")
    laid.write.bucketBy(parts, "doc_id").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    try:
        named = texts
        cuts = write_table(named.mapInArrow(_cut, "doc_id long, key long, h1 long, h2 long, at int, n int"), "cuts")
        again = cuts.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
        runs = write_table(cuts.join(again, ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list(F.struct("key", "at", "n")).alias("runs")), "runs")
        windows = cuts.agg(F.sum("n")).first()[0] or 0

        groups = max(1, -(-int(windows) // ANCHOR_GROUP))
        open_ = named.join(runs, "doc_id", "left")
        packed = open_.select("doc_id", "key", "text", "runs").mapInArrow(_anchors(groups), "group int, anchors binary, first binary, known binary, docs binary, place binary")
        hits = packed.groupBy("group").applyInArrow(_meet, "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
        hits = write_table(hits, "hits")

        occurs = write_table(open_.join(hits, "doc_id").select("doc_id", "key", "text", "runs", "anchors").mapInArrow(_pieces, "anchor long, h1 long, h2 long, piece binary, doc_id long, key long, at int"), "pieces")
        once = write_table(occurs.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.any_value("piece").alias("piece")), "once")
        rows = once.groupBy("anchor").count()
        hot = write_table(rows.where(F.col("count") > HOT).select("anchor"), "hot")
        groups = max(1, -(-once.count() // PIECE_GROUP))
        rest = once.join(hot, "anchor", "left_anti").select("anchor", "h1", "h2", "lo", "piece")
        found = rest.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("g")).applyInArrow(_resolve, "anchor long, h1 long, h2 long, mins array<long>")
        if not hot.isEmpty():
            found = found.union(_by_window(once.join(hot, "anchor", "left_semi")))
        late = once.select("anchor", "h1", "h2", "hi")
        found = write_table(found.join(late, ["anchor", "h1", "h2"]).where(F.array_min("mins") < F.col("hi")).drop("hi"), "found")
        flags = occurs.drop("piece").join(found, ["anchor", "h1", "h2"]).where(F.array_min("mins") < F.col("doc_id"))
        flags = flags.select("doc_id", F.struct("key", "at", F.transform("mins", lambda m: m < F.col("doc_id")).alias("flags")).alias("one")).groupBy("doc_id").agg(F.collect_list("one").alias("found"))

        done = texts.join(runs, "doc_id", "left").join(flags, "doc_id", "left").select("doc_id", "key", "text", "runs", "found")
        # Rows without an id take no part: they go straight to the last step.
        alone = every.where("doc_id is null").select("doc_id", "key", "text", *(F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("runs", "found")))
        done = done.union(alone).mapInArrow(_remove(keep_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
        return write_table(done, "kept")
    finally:
        spark.sql(f"drop table if exists {name}")
