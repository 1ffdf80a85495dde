"""Embedding near-dedup by iterative quantisation.

Rotations learned on a bounded sample of centred unit vectors turn all vectors into balanced binary codes (several
rotations where one gives too few bits). The codes are cut into tables of substrings; vectors with an equal substring
meet. First only short sketches of the codes travel, and vectors without a partner within the Hamming radius drop out.
The others meet again with their original vectors, and the cosine in double precision decides. A pair is counted in
the first table in which it meets. Buckets of more than TILE vectors are cut into tiles, each pair of tiles a
group of its own; only counts and one link to a root leave a tile, never all pairs.

The number of tables is set so that a pair at the least cosine is missed with MISS probability at most, by the chance
that a bit differs: the angle, over pi, that such a pair has once centred, for all but the SHORT share of the sample's
centred lengths. Substrings grow with the logarithm of the vectors. Sample bound: SAMPLE vectors of each length;
every vector is indexed.

Vectors that are null, zero, hold null or non-finite components link with nothing; vectors of another length are
indexed among themselves. Equal vectors form one class and link with each other. Rows with the same vec_id are
separate vectors of one name, and the smallest name that a vector reaches names its component; a null vec_id is never
a component's name unless it stays alone (component_id null, kept true). Cosines equal to the least one link. Extra
columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .common import drop_tables, told_apart, tune, write_table
from .graph import least_names, look_up

LEAST, MISS, SAMPLE, SHORT = 0.9, 1e-3, 4096, 0.02
#: Bits of a code that the first comparison takes.
SKETCH = 256
TILE, GROUP_ROWS, ROTATIONS_STEPS = 1024, 50_000, 30


def centre(sample: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, float]:
    """Mean of the unit vectors, and the chance that a bit differs for a pair at cosine ``least``, once centred."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    chord = math.sqrt(2 * (1 - least))
    lengths = np.linalg.norm(unit - mean, axis=1)
    # Where vectors lie closer to their mean than pairs to each other, centring would hide the pairs.
    if np.quantile(lengths, SHORT) < chord:
        return np.zeros_like(mean), math.acos(least) / math.pi
    return mean, 2 * math.asin(chord / (2 * float(np.quantile(lengths, SHORT)))) / math.pi


def learn_rotations(sample: np.ndarray, mean: np.ndarray, bits: int, seed: int = 11) -> np.ndarray:
    """Projections [dimension, bits]: principal directions times rotations fitted by iterative quantisation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) - mean
    dim = unit.shape[1]
    _, _, axes = np.linalg.svd(unit, full_matrices=False)
    axes = axes.T if axes.shape[0] == dim else np.eye(dim)
    data, out, rng = unit @ axes, [], np.random.default_rng(seed)
    while sum(x.shape[1] for x in out) < bits:
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(ROTATIONS_STEPS):
            u, _, v = np.linalg.svd(np.where(data @ turn >= 0, 1.0, -1.0).T @ data)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def plan(n: int, chance: float = math.acos(LEAST) / math.pi, miss: float = MISS) -> tuple[int, int]:
    """Bits of a substring and number of tables for n vectors."""
    bits = min(62, max(4, math.ceil(math.log2(max(n, 1) / 64 + 1))))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - (1 - chance) ** bits)))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coder(projection: np.ndarray, mean: np.ndarray, bits: int, tables: int) -> Callable:
    weight = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column("embedding"))
            sign = vectors @ projection >= np.linalg.norm(vectors, axis=1, keepdims=True) * (mean @ projection)
            codes = (sign.reshape(-1, tables, bits) @ weight).astype(np.int64)
            border = pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("m"), pa.ListArray.from_arrays(border, pa.array(codes.reshape(-1))), pa.array([x.tobytes() for x in np.packbits(sign[:, :SKETCH], axis=1)], pa.binary())],
                names=["rep", "m", "codes", "packed"],
            )

    return run


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _near(radius: int) -> Callable[[pa.Table], pa.Table]:
    """Vectors that have a partner within the Hamming radius in some bucket."""

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        packed = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(len(rep), -1)
        good = np.zeros(len(rep), bool)
        for _, one, two in tiles.pairs_of_tiles(table, ["t", "code"]):
            for at in range(0, len(one), 256):
                part = one[at : at + 256]
                distance = _ONES[packed[part][:, None, :] ^ packed[two][None, :, :]].sum(axis=2, dtype=np.int32)
                hit = (distance <= radius) & (rep[part][:, None] != rep[two][None, :])
                good[part] |= hit.any(axis=1)
                good[two] |= hit.any(axis=0)
        return pa.table({"rep": np.unique(rep[good])})

    return run


def _links(least: float) -> Callable[[pa.Table], pa.Table]:
    """For each vector of each bucket: weight of links first met here, and the least vector it reaches here."""

    def run(table: pa.Table) -> pa.Table:
        rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
        vectors = _vectors(table.column("embedding"))
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        codes = table.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
        reps, counts, roots = [], [], []
        for key, one, two in tiles.pairs_of_tiles(table, ["t", "code"]):
            near = vectors[one] @ vectors[two].T >= least
            near &= rep[one][:, None] != rep[two][None, :]
            if not near.any():
                continue
            fresh = near.copy()
            for earlier in range(key["t"]):
                fresh &= codes[one, earlier][:, None] != codes[two, earlier][None, :]
            root_one, root_two = tiles.roots(near, rep[one], rep[two], one is two)
            touched = near.any(axis=1)
            reps.append(rep[one][touched])
            counts.append((fresh * m[two][None, :]).sum(axis=1)[touched])
            roots.append(root_one[touched])
            if one is not two:
                touched = near.any(axis=0)
                reps.append(rep[two][touched])
                counts.append((fresh * m[one][:, None]).sum(axis=0)[touched])
                roots.append(root_two[touched])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"rep": np.concatenate(reps or empty).astype(np.int64), "links": np.concatenate(counts or empty).astype(np.int64), "root": np.concatenate(roots or empty).astype(np.int64)})

    return run


def _deal(placed: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
    """Rows of (t, code, ...) dealt to groups ``g`` of whole buckets; large buckets go in pairs of tiles."""
    named = placed.join(hot, ["t", "code"], "left")
    return tiles.deal(named, ["t", "code"], "rep", F.coalesce("tiles", F.lit(1)), max(1, -(-rows // GROUP_ROWS))).drop("tiles")


def _found(classes: DataFrame, least: float, miss: float) -> DataFrame:
    """(rep, links, root) of the vectors of one length, a row for each bucket in which a vector has links."""
    n = classes.count()
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64(F.lit("sample"), "rep")).limit(SAMPLE).select("embedding").collect()])
    mean, chance = centre(sample, least)
    bits, tables = plan(n, chance, miss)
    projection = learn_rotations(sample, mean, bits * tables)
    coded = write_table(classes.select("rep", "m", "embedding").mapInArrow(_coder(projection, mean, bits, tables), "rep long, m long, codes array<long>, packed binary"), "codes")
    width = min(bits * tables, SKETCH)
    radius = math.ceil(width * chance + 6 * math.sqrt(width * chance * (1 - chance)))

    def placed(what: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
        put = what.select("rep", *more, F.posexplode("codes").alias("t", "code"))
        hot = what.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").count().where(F.col("count") > TILE)
        return put, write_table(hot.select("t", "code", F.ceil(F.col("count") / TILE).alias("tiles")), "hot")

    put, hot = placed(coded, "packed")
    near = _deal(put, hot, n * tables).groupBy("g").applyInArrow(_near(radius), "rep long")
    near = write_table(near.distinct(), "near")

    kept = coded.join(near, "rep").join(classes.select("rep", "embedding"), "rep")
    kept = write_table(kept.select("rep", "m", "codes", "embedding"), "reranked")
    put, hot = placed(kept, "m", F.col("codes").alias("all"), "embedding")
    put = put.withColumnRenamed("all", "codes")
    found = write_table(_deal(put, hot, kept.count() * tables).groupBy("g").applyInArrow(_links(least), "rep long, links long, root long"), "links")
    drop_tables(coded, near, kept)
    return found


def near_vectors(table: DataFrame, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding, ...)."""
    tune(table.sparkSession)
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.when(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull(), F.xxhash64("embedding")).alias("rep"), F.xxhash64(F.lit("more"), "embedding").alias("more"))
    rows = told_apart(write_table(rows, "rows"), "rep", "more")
    classes = write_table(rows.where("rep is not null").groupBy("rep").agg(F.min("vec_id").alias("name"), F.count("*").alias("m"), F.first("embedding").alias("embedding")), "vectors")
    found = None
    for r in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect():
        one = _found(classes.where(F.size("embedding") == r["n"]), least, miss)
        found = one if found is None else found.union(one)
    known = classes.select("rep", "name", "m")
    if found is not None:
        component = least_names(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), classes.select("rep", "name"))
        count = found.groupBy("rep").agg(F.sum("links").alias("links")).toDF("linked", "links")
        known = known.join(component, F.col("rep") == F.col("v"), "left").join(count, F.col("rep") == F.col("linked"), "left")
        known = known.select("rep", "name", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component", "name").alias("component"))
    else:
        known = known.select("rep", "name", (F.col("m") - 1).alias("links"), F.col("name").alias("component"))
    known = write_table(known.select("rep", F.struct("links", "component").alias("known")), "known")
    out = look_up(rows.select("vec_id", "rep"), "rep", known, table.count(), "known")
    root = F.coalesce("known.component", "vec_id")
    return out.select("vec_id", F.coalesce("known.links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(True)).alias("kept"))
