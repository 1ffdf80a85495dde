"""MinHash near-dedup by circulant MinHash.

Two permutations make every coordinate of the signature: shingle hashes pass through the first, the
result is shifted on the ring of 2**32 points by a multiple of a fixed stride for coordinate k, and the
second permutation ranks it. Coordinates are banded, and texts that meet in a bucket are compared on
their full shingle sets.

Texts with the same shingle set (by a digest of 128 bits) form one class before banding, so copies cost one row. In a bucket not
all pairs are made: members are first compared with one hub, then with the members that have most links; at
last the pairs of a bucket that no chain of confirmed links joins yet are compared in pairs of tiles. A
component is complete for the pairs that share a bucket.

Nulls, empty texts: no shingles, linked with nothing. Repeated rows are copies of each other. Rows that share
a doc_id but not the text are judged each by its own text; the smallest id that a row reaches names its
component. A null doc_id stays alone (component_id null, kept true). Texts of any length count whole. Equal
candidates for a hub: the smaller id. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import drop_tables, slices, text_key, told_apart, tune, write_table
from .graph import connected_components, least_names, look_up
from .tiles import deal, pairs_of_tiles, roots

BANDS, ROWS = 32, 4
SHINGLE = 5
#: Percent of the union that the intersection has at least.
PERCENT = 75
#: Hubs of a bucket in the rounds before the rest is compared in tiles.
HUBS = (2,)
#: Members and shingles of a tile, and shingles compared at once, in the comparison of what hubs left open.
TILE, TILE_SHINGLES, COLUMNS = 512, 500_000, 4096
STRIDE = np.uint32(0x9E3779B1)


def _rank(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(values: np.ndarray, border: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of every nonempty set: uint32 [sets, coordinates]."""
    first = (K.mix(values * K.M1) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(border) - 1, coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_rank(first + np.uint32((k * int(STRIDE)) & 0xFFFFFFFF)), border[:-1])
    return out


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_bytes(batch.column("text"))
    return K.distinct_sets(*K.shingles(*K.word_hashes(data, offsets), SHINGLE), batch.num_rows)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, border = _sets(batch)
        n = np.diff(border)
        full = np.flatnonzero(n)
        one = np.zeros((2, batch.num_rows), np.uint64)
        keys = np.zeros((len(full), BANDS), np.uint64)
        if len(full):
            for j in range(2):
                one[j, full] = np.add.reduceat(K.mix(values + np.uint64((int(K.M1) * (j + 1)) % 2**64)), border[full])
            sign = signatures(values, np.append(border[full], len(values)), BANDS * ROWS).reshape(len(full), BANDS, ROWS)
            keys[:] = np.arange(1, BANDS + 1, dtype=np.uint64) * K.M1
            for r in range(ROWS):
                keys = K.mix(keys * K.BASE + sign[:, :, r])
        border_out = np.zeros(batch.num_rows + 1, np.int32)
        border_out[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
        bands = pa.ListArray.from_arrays(pa.array(border_out), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n.astype(np.int64)), pa.array(one[0].view(np.int64)), pa.array(one[1].view(np.int64)), bands], names=["doc_id", "key", "n_shingles", "d1", "d2", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, border = _sets(batch)
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(values.view(np.int64)))], names=["rep", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose full sets are similar."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    met = pairs.join(right, "b").join(left, "a").where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    both = met.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (na + nb).alias("n"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, key (the text_key) for every row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", text_key(F.col("text")))
    seen = write_table(texts.mapInArrow(_describe, "doc_id long, key long, n_shingles long, d1 long, d2 long, bands array<long>").withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("d1", "d2"))), "minhash")
    seen = told_apart(seen, "rep", "d1", "d2")
    classes = write_table(seen.where("rep is not null").groupBy("rep").agg(F.min(F.struct("doc_id", "key")).alias("one"), F.first("bands").alias("bands")), "classes")

    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).where("members > 1")
    member = write_table(placed.join(shared, "bucket").select("bucket", "rep", "hub"), "buckets")
    wanted = member.select("rep").distinct().join(classes.select("rep", "one.doc_id", "one.key"), "rep")
    sets = write_table(texts.join(wanted, ["doc_id", "key"]).select("rep", "text").mapInArrow(_full_sets, "rep long, shingles array<long>").dropDuplicates(["rep"]), "sets")

    stars = write_table(member.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links, tested = write_table(_confirm(stars, sets, percent), "links"), stars
    component = connected_components(links)
    for hubs in HUBS:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
        open_ = write_table(_mixed(member, component).join(degree, "rep", "left").select("bucket", "rep", "component", F.coalesce("degree", F.lit(0)).alias("degree")), "open")
        top = _top(open_, hubs).select("bucket", F.col("h.rep").alias("y"), F.col("h.component").alias("cy"))
        fresh = open_.join(top, "bucket").where("component <> cy").select(F.least("rep", "y").alias("a"), F.greatest("rep", "y").alias("b")).distinct()
        pairs = write_table(fresh.join(tested, ["a", "b"], "left_anti"), "pairs")
        drop_tables(open_)
        if pairs.isEmpty():
            break
        links, tested = links.union(write_table(_confirm(pairs, sets, percent), "links")), tested.union(pairs)
        component = connected_components(links)
    rest = _rest(member, component, sets, percent)
    component = least_names(links.union(rest), classes.select("rep", "one.doc_id"))
    drop_tables(member, sets, tested)

    names = classes.select("rep", "one.doc_id").join(component, F.col("rep") == F.col("v"), "left").select("rep", F.coalesce("component", "doc_id").alias("component"))
    out = look_up(seen.select("doc_id", "key", "n_shingles", "rep"), "rep", write_table(names, "names"), seen.count(), "component")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), "key")


def _mixed(member: DataFrame, component: DataFrame) -> DataFrame:
    """Members (bucket, rep, component) of the buckets that confirmed links don't join yet."""
    known = member.select("bucket", "rep").join(component, F.col("rep") == F.col("v"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return known.join(mixed, "bucket")


def _top(open_: DataFrame, hubs: int) -> DataFrame:
    """Members of many links of every bucket: the best of each of ``hubs`` parts."""
    best = F.max_by(F.struct("rep", "component"), F.struct("degree", -F.col("rep")))
    return open_.groupBy("bucket", F.pmod(F.xxhash64("rep"), F.lit(hubs)).alias("part")).agg(best.alias("h"))


def _compare(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Roots of members that are linked within a pair of tiles, for members not joined before."""

    def run(table: pa.Table) -> pa.Table:
        rep, component, loose = (table.column(c).to_numpy() for c in ("rep", "component", "loose"))
        lists = table.column("shingles").combine_chunks()
        values, border = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = np.diff(border)
        reps, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, one, two in pairs_of_tiles(table, ["bucket"]):
            open_ = (component[one][:, None] != component[two][None, :]) & (loose[one][:, None] | loose[two][None, :])
            if not open_.any():
                continue
            common = _common([values[border[r] : border[r + 1]] for r in one], [values[border[r] : border[r + 1]] for r in two])
            near = open_ & (100 * common >= percent * (size[one][:, None] + size[two][None, :] - common))
            if near.any():
                for ids, root, axis in zip((rep[one], rep[two]), roots(near, rep[one], rep[two], one is two), (1, 0), strict=True):
                    hit = near.any(axis=axis)
                    reps.append(ids[hit])
                    found.append(root[hit])
        return pa.table({"a": np.concatenate(found), "b": np.concatenate(reps)})

    return run


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    out = np.zeros((len(one), len(two)), np.int64)
    flat = [np.concatenate(x) for x in (one, two)]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    both = np.intersect1d(*flat)
    place = [np.searchsorted(both, f) for f in flat]
    real = [both[np.minimum(p, len(both) - 1)] == f if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat, strict=True)]
    for start in range(0, len(both), COLUMNS):
        grid = []
        for p, ok, r, n in zip(place, real, rows, (len(one), len(two)), strict=True):
            here = ok & (p >= start) & (p < start + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(both) - start)), np.float32)
            m[r[here], p[here] - start] = 1.0
            grid.append(m)
        out += np.rint(grid[0] @ grid[1].T).astype(np.int64)
    return out


def _rest(member: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the hubs have missed.

    In buckets that confirmed links don't join yet, the members outside the bucket's largest component are
    compared with all others of the bucket, in pairs of tiles.
    """
    sized = write_table(_mixed(member, component).join(sets.select("rep", F.size("shingles").alias("n")), "rep"), "rest-members")
    parts = sized.groupBy("bucket", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    groups = parts.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max_by("component", F.struct("rows", "component")).alias("largest"))
    weight = F.greatest(F.col("rows") / TILE, F.col("n") / TILE_SHINGLES)
    mixed = write_table(groups.select("bucket", "largest", F.ceil(weight).alias("tiles"), weight.alias("weight")), "mixed")
    members = sized.join(mixed, "bucket").select("bucket", "rep", "component", (F.col("component") != F.col("largest")).alias("loose"), "tiles")
    total = mixed.agg(F.sum(F.col("tiles") * F.col("weight"))).first()[0] or 0
    placed = deal(members.join(sets, "rep"), ["bucket"], "rep", F.col("tiles"), max(1, math.ceil(total))).drop("tiles")
    found = write_table(placed.groupBy("g").applyInArrow(_compare(percent), "a long, b long").distinct(), "rest")
    drop_tables(sized, mixed)
    return found
