"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so similarity of whole signatures says nothing. Items are put into
partitions by the number n of their shingles (powers of two). Of a partition's items, at least
``need = ceil(threshold * n)`` shingles must stand in a document; that bounds the Jaccard similarity to a document
of u shingles by need / (n + u - need) from below, and any document that reaches it holds one of the item's
``n - need + 1`` least shingle hashes. So these are the item's sketch (a bottom-k MinHash whose k follows the
partition), and a document's sketch for the partition are its hashes up to the partition's cut, the largest hash in
a sketch of the partition. A document meets a partition only if it has words enough for the partition's least need.
Sketches that share a hash make a candidate; none is missed. Candidates are verified by the exact share of the
item's shingles, compared as text, that the whole document holds.

Words are runs of letters and digits, lowered; shingles are SHINGLE words, or all of an item's words where it
has fewer. Items and documents that are null or have no word match nothing. Repeated items with different
item_id are separate items; rows that share an item_id count as one item with the shingles of all. Rows that share
a doc_id are judged each by its own text, equal rows once; null ids match nothing. Shares equal to the threshold
match. Texts of any length count whole. An empty table on either side gives an empty table. Everything is DataFrame
functions; documents are split into words once for the search, and candidates once more to verify them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key, without_rows, write_table

SHINGLE, THRESHOLD = 5, 0.75
#: Bytes of a table that is broadcast at most, counted as its strings and 64 bytes a row; a larger one is joined by a shuffle.
BROADCAST = 32 << 20
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(WORD), F.lit(0))


def small(df: DataFrame, strings: str | None = None, most: int = BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if its rows and the column ``strings`` have at most ``most`` bytes, as counted."""
    size = df.agg(F.sum(F.lit(64) + (F.octet_length(strings) if strings else 0))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def _shingles(df: DataFrame, widths: list[int]) -> DataFrame:
    """``df`` (w: words, ...) once for every shingle, with words (its width), at (from 0) and hash."""
    # An outer explode: else a filter on the words is inferred below it and they are split twice.
    size = F.size("w")
    out = df.select("*", F.explode_outer(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("at")).where("at is not null")
    out = out.withColumn("words", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0])).where(F.col("at") + F.col("words") <= F.size("w"))
    value = None
    for n in widths:
        one = F.xxhash64(F.lit(n), *[F.get("w", F.col("at") + k) for k in range(n)])
        value = F.when(F.col("words") == n, one) if value is None else value.when(F.col("words") == n, one)
    return out.withColumn("hash", value)


def _text(w: Column) -> Column:
    return F.array_join(F.slice(w, F.col("at") + 1, F.col("words")), " ")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment, key (text_key) of every pair at or above the threshold."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null")
    own = F.least(F.size("w"), F.lit(size))
    held = _shingles(named, list(range(1, size + 1))).where(F.col("words") == own).select("item_id", "words", "hash", _text(F.col("w")).alias("shingle")).distinct()
    count = held.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    full = write_table(held.join(count, "item_id"), "items")
    need = F.ceil(F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)).cast("int")
    ranked = full.groupBy("item_id", "n_shingles").agg(F.sort_array(F.collect_set(F.struct("hash", "words"))).alias("all"))
    sketch = F.slice("all", F.lit(1), F.greatest(F.size("all") - need + 1, F.lit(1)))
    part = F.ceil(F.log2(F.col("n_shingles").cast("double"))).cast("int").alias("part")
    probes = write_table(ranked.select("item_id", part, need.alias("need"), F.explode(sketch).alias("p")).select("item_id", "part", "need", "p.hash", "p.words"), "probes")
    cuts = probes.groupBy("words", "part").agg(F.max("hash").alias("cut"), F.min("need").alias("least")).collect()
    out = "doc_id long, item_id long, n_shingles long, n_found long, containment double, key long"
    if not cuts:
        return docs.sparkSession.createDataFrame([], out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").where("doc_id is not null")
    widths = sorted({r["words"] for r in cuts})
    # One row of cuts for each width and partition, a few dozen at most.
    in_sketch = F.lit(False)
    for r in cuts:
        in_sketch = in_sketch | ((F.col("words") == r["words"]) & (F.col("hash") <= r["cut"]) & (F.size("w") >= r["least"] + r["words"] - 1))
    sketches = _shingles(texts.select("doc_id", "key", words(F.col("text")).alias("w")), widths).where(in_sketch)
    candidates = write_table(sketches.join(small(probes.select("item_id", "hash", "words")), ["hash", "words"]).select("doc_id", "key", "item_id").distinct(), "candidates")

    ids = candidates.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).distinct()
    chosen = texts.join(small(ids), (F.col("doc_id") == F.col("c_id")) & (F.col("key") == F.col("c_key")), "left_semi").select("doc_id", "key", words(F.col("text")).alias("w"))
    met = _shingles(chosen, widths).join(small(full, "shingle"), ["hash", "words"]).where(_text(F.col("w")) == F.col("shingle"))
    met = met.select("doc_id", "key", "item_id", "n_shingles", "shingle").distinct().groupBy("doc_id", "key", "item_id", "n_shingles").agg(F.count("*").alias("n_found"))
    met = met.join(candidates, ["doc_id", "key", "item_id"], "left_semi")
    return met.where(F.col("n_found") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9)).select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"), "key")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``docs`` without the rows whose text contains an item; rows with a null doc_id stay."""
    return without_rows(docs, contained_items(docs, items, threshold, size).select("doc_id", "key"))
