"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, write_table

#: Links that a task thins out at once; rows that share a key in one task, and keys with more of them, at most.
CHUNK, HEAVY, HEAVY_KEYS = 50_000, 50_000, 100_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of the component of each, by hooking and pointer jumping."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        for end in (label[one], label[two], one, two):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every CHUNK links as stars around the least vertex of each component they make: never more links than before."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        v, low = least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(low[v != low]), pa.array(v[v != low])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in held) >= CHUNK:
            yield stars()
    if held:
        yield stars()


def look_up(rows: DataFrame, key: str, table: DataFrame, n: int, name: str) -> DataFrame:
    """``rows`` (n of them) with ``name``: the value that ``table`` (v, value; one row for each v) has for ``key``, else null.

    Keys of very many rows are not brought into one task: there are at most HEAVY_KEYS of them, so their values
    are broadcast, and only the other rows are joined by a shuffle.
    """
    v, value = table.columns
    plain = table.select(F.col(v).alias("key_"), F.col(value).alias("value_"))
    least = max(HEAVY, n // HEAVY_KEYS)
    if n <= least:
        return rows.join(plain, F.col(key) == F.col("key_"), "left").select(*rows.columns, F.col("value_").alias(name))
    each = plain.select("key_", "value_", F.lit(0).alias("one_")).union(rows.select(F.col(key), F.lit(None).cast(plain.schema["value_"].dataType), F.lit(1)))
    heavy = each.groupBy(F.col("key_").alias("heavy_")).agg(F.max("value_").alias("heavy_value_"), F.sum("one_").alias("rows_")).where((F.col("rows_") > least) & F.col("heavy_").isNotNull())
    marked = rows.join(F.broadcast(heavy.drop("rows_")), F.col(key) == F.col("heavy_"), "left")
    # Rows with a heavy or a null key are dealt out by their values and meet nothing.
    light = F.col("heavy_").isNull() & F.col(key).isNotNull()
    spread = marked.withColumns({"dealt_": F.when(light, F.col(key)).otherwise(F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)), "light_": light})
    met = spread.join(plain.withColumn("all_", F.lit(True)), (F.col("dealt_") == F.col("key_")) & (F.col("light_") == F.col("all_")), "left")
    return met.select(*rows.columns, F.coalesce("heavy_value_", "value_").alias(name))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of every vertex in ``edges`` (a, b: long).

    Returns (v, component). The graph is contracted in rounds: each vertex points to its least neighbour, the
    lesser of two that point to each other becomes a root, pointers jump until all end in roots, and the links
    between roots are the next graph. Every tree has two vertices or more, so a round halves the vertices at
    least; a root is the least vertex of its tree. Before each round every task thins out its own links in chunks
    of fixed size. The vertices of each round take the component of their root on the way back. Minima are
    combined before a shuffle and hubs are looked up by ``look_up``, so a hub of any degree is no hot group.
    Null ends and loops are ignored; an empty table gives an empty table.
    """
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    graph = write_table(clean, "edges")
    layers: list[tuple[DataFrame, int]] = []
    while n := graph.count():
        thin = write_table(graph.coalesce(-(-n // CHUNK)).mapInArrow(_thin, "a long, b long"), "thin")
        drop_tables(graph)
        both = thin.union(thin.select("b", "a")).toDF("v", "u")
        least = write_table(both.groupBy("v").agg(F.min("u").alias("p")), "least")
        size = least.count()
        # The neighbour's least neighbour is v or less, and the lesser of the two pointers is an ancestor of v.
        parents = write_table(look_up(least, "p", least, size, "pp").select("v", F.least("p", "pp").alias("p")), "parents")
        drop_tables(least)
        while True:
            jumped = write_table(look_up(parents, "p", parents, size, "pp"), "jumped")
            moved = not jumped.where("p <> pp").isEmpty()
            drop_tables(parents)
            if not moved:
                parents = jumped.select("v", "p")
                break
            parents = write_table(jumped.select("v", F.col("pp").alias("p")), "parents")
            drop_tables(jumped)
        layers.append((parents, size))
        ends = look_up(look_up(thin, "a", parents, n, "ra"), "b", parents, n, "rb").where("ra <> rb")
        graph = write_table(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop_tables(thin)
    if not layers:
        return graph.toDF("v", "component")
    out = layers[-1][0].toDF("v", "component")
    for parents, size in reversed(layers[:-1]):
        up = look_up(parents, "p", out, size, "top")
        out = write_table(up.select("v", F.coalesce("top", "p").alias("component")), "labels")
    return out


def least_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Of every vertex in ``edges``, the least name reachable: (v, component); ``names`` is (v, name: long).

    For vertices that are not names themselves, as where several vertices share a name.
    """
    roots = connected_components(edges)
    known = write_table(roots.join(names.toDF("named_", "name"), F.col("v") == F.col("named_")).select("v", "component", "name"), "named")
    lowest = known.groupBy("component").agg(F.min("name").alias("lowest"))
    return write_table(look_up(known.select("v", F.col("component").alias("root")), "root", lowest, known.count(), "component").select("v", "component"), "names")
