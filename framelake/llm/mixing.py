"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the fractional number of copies target / size of its source. Documents of a source
meet in pairs; mass moves at random from one to the other, weighed by their sizes, until one of the two
has a whole number of copies. The expected copies of each document stay, and so does the sum of words of
the pair, so what a source takes differs from its target by the rounding of one last document. Each group
(source, bucket) hands its one undecided document to the next level of a tree, until a source has one
group left. Rows are dealt to groups by id, text and number among equal rows, so groups hold a bounded number of
rows however large a source or a group of copies is.

Nulls: a null text has size 0 and takes 0; null source is a source of its own, last in order; null ids are dealt out
by their text. Texts without words take 0; texts of any length count whole. Repeated rows are separate rows, and
which of them gets which number of copies does not matter; rows that share an id are rounded each by itself. Reruns
give the same rows whatever the layout of the table: the random numbers come from the seed, the row and the level.
Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_key, tune, write_table

#: Weights by order of source, repeating; share of all words; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
GROUP, FAN = 2_000, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): share of all sizes by weight, at most ``most`` times the size.

    Sources are ranked by ranges, not in one task. What full sources leave over is shared again by weight until no
    source is above its cap; each turn takes one pair of sums, and the full ones only become more.
    """
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    laid = write_table(spread, "sources")
    before = laid.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect()
    offsets = laid.sparkSession.createDataFrame([(r["part"], sum(x["rows"] for x in before[:i])) for i, r in enumerate(before)], "p int, offset long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = laid.withColumn("nth", nth).join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn("rank", F.col("offset") + F.col("nth") - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    t = write_table(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "ranked")
    total, level, full = t.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        sums = t.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("done"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"), F.count_if(above).alias("full")).first()
        if sums["full"] == full or not sums["open"]:
            break
        full, level = sums["full"], (total * share - sums["done"] * most) / sums["open"]
    filled = F.col("cap") if not sums["open"] else F.least("cap", F.col("weight") * F.lit(level))
    return t.select("source", "source_size", filled.cast("double").alias("target"))


def _pivot(rows: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Round all rows of a group but one; at the last level that one too."""
    rows = rows.sort_values(["doc_id", "size", "key", "row"], kind="stable", na_position="last").reset_index(drop=True)
    part, size = rows["part"].to_numpy(copy=True), rows["size"].to_numpy(np.float64)
    draw = np.random.default_rng([seed, int(rows["level"].iloc[0]), int(rows["mark"].iloc[0]) & 0x7FFFFFFF]).random(len(rows) + 1)
    keep = -1
    for i in range(len(rows)):
        if not 0.0 < part[i] < 1.0:
            continue
        if keep < 0:
            keep = i
            continue
        a, b = keep, i
        ratio = size[a] / size[b]
        up = min(1.0 - part[a], part[b] / ratio)
        down = min(part[a], (1.0 - part[b]) / ratio)
        if draw[i] * (up + down) < down:
            whole_a = up == 1.0 - part[a]
            part[a], part[b] = part[a] + up, part[b] - up * ratio
            done = a if whole_a else b
            part[done] = 1.0 if whole_a else 0.0
        else:
            whole_a = down == part[a]
            part[a], part[b] = part[a] - down, part[b] + down * ratio
            done = a if whole_a else b
            part[done] = 0.0 if whole_a else 1.0
        keep = b if done == a else a
        if part[keep] < 1e-12 or part[keep] > 1 - 1e-12:
            part[keep] = round(part[keep])
            keep = -1
    if last and keep >= 0:
        part[keep] = 1.0 if draw[-1] < part[keep] else 0.0
    rows["part"] = part
    return rows


def _rounder(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _pivot(rows, seed, last)

    return run


def mix_sources(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source for every row of ``docs``."""
    tune(docs.sparkSession)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), text_key(F.col("text")).alias("key"))
    # Equal rows are numbered: first in runs, which are dealt out, then within them.
    equal = sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / GROUP)))).repartition("doc_id", "key", "run")
    table = write_table(runs.withColumn("row", F.explode(F.sequence(F.col("run") * GROUP, F.least((F.col("run") + 1) * GROUP, "rows") - 1))).drop("rows", "run"), "sizes")
    sums = table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    known = write_table(targets(sums.select("source", "source_size"), weights, share, most), "targets")
    most_rows = sums.agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-int(most_rows) // GROUP))

    # Every source is dealt to as many groups as its own rows fill.
    own = sums.select(F.col("source").alias("s"), F.ceil(F.col("n") / GROUP).cast("int").alias("own"))
    s = known.join(own, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "own")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + F.lit(1e-12))
    named = table.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = named.select(
        "doc_id", "source", "size", "key", "row", "source_size", "target", base.cast("double").alias("base"),
        F.when((F.col("size") > 0) & (rate - base > 1e-12), rate - base).otherwise(0.0).alias("part"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key", "row"), F.col("own")).alias("bucket"),
    )
    settled, level = None, 0
    while True:
        last = buckets == 1
        marked = rows.withColumns({"level": F.lit(level), "mark": F.xxhash64("source", "bucket")})
        done = write_table(marked.groupBy("source", "bucket").applyInPandas(_rounder(seed, last), marked.schema).drop("level", "mark"), "rounded")
        whole = done.where("part = 0 or part = 1") if not last else done
        settled = whole if settled is None else settled.unionByName(whole)
        if last:
            break
        rows = done.where("part > 0 and part < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN))
        buckets, level = -(-buckets // FAN), level + 1
    copies = (F.col("base") + F.col("part")).cast("long")
    return settled.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")
