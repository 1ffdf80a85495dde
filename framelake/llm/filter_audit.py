r"""Audit of how five filters interact, by a relational word pipeline.

Words are exploded, counted by (document, word) and then by document for totals and distinct words. The flags that need
no words are joined to these counts: capital letters, marks, and texts that stand under a smaller doc_id too. The five
flags of a document are one number from 0 to 31, and one aggregation counts documents in 32 columns, one for each
number. Everything about any order of the filters follows from these counts.

Filters (FILTERS; a document fails if the condition holds): A fewer than 200 words; B distinct words under 50 % of the
words; C capitals A-Z over 3 % of the code points; D any of # $ % & * |; E the text stands under a smaller doc_id too,
removed or not.

A null text is empty (0 words: A holds, B and C do not); a null lang is the part ''. Rows that share a doc_id are
judged each by its own text, and each row counts as a document; E asks for a smaller id, so repeated rows of one id do
not fail it, and neither do rows with a null id nor rows beside them. A document is good (toxic) if any label row of its
id says so; null labels and label rows without a document count for nothing. No documents give no rows. Texts of any
length count whole. Other columns, whatever their names, are not looked at.

Texts are shuffled once, by document and before they are exploded, so both counts of words follow without another
shuffle and no document is spread; a text of any number of copies is looked up without bringing them together.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced_words, split_words, text_key, write_table
from .graph import look_up

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
MARKS = "[#$%&*|]"
SPACE = r"\x20\x09-\x0D"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_distinct for every (doc_id, key) of ``rows`` (doc_id, key, text)."""
    text = spaced_words(F.col("text"), SPACE)
    # A null word stands for the document itself: it counts its rows, and keeps documents without words.
    marked = F.concat(F.array(F.lit(None).cast("string")), split_words(F.col("spaced")))
    dealt = rows.select("doc_id", "key", text.alias("spaced")).repartition("doc_id", "key")
    words = dealt.select("doc_id", "key", F.explode(marked).alias("word")).groupBy("doc_id", "key", "word").agg(F.count("*").alias("n"))
    own = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    return words.groupBy("doc_id", "key").agg((F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0)) / own).cast("long").alias("n_words"), F.count("word").alias("n_distinct"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and mask (bit 0: A fails, to bit 4: E fails) for every row of ``docs``."""
    rows = _rows(docs)
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    seen = rows.select(
        "doc_id", "key", "part", (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(MARKS).alias("d"), F.sha2("text", 256).alias("digest"),
    )
    seen = write_table(seen, "flags")
    least = seen.groupBy("digest").agg(F.min("doc_id").alias("least"))
    with_least = look_up(seen, "digest", least, seen.count(), "least")
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality"), F.col("toxic")).where("l_id is not null").groupBy("l_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    counts = word_counts(rows).withColumnsRenamed({"doc_id": "w_id", "key": "w_key"})
    met = with_least.join(counts, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left").join(marks, F.col("doc_id") == F.col("l_id"), "left")
    fails = [F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"), F.col("c"), F.col("d"), F.col("least") < F.col("doc_id")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return met.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), mask.alias("mask"))


def _over(counts: str, body) -> Column:
    """The sum of ``counts`` (an array by mask) over the masks for which ``body`` holds."""
    taken = F.transform(F.col(counts), lambda n, m: F.when(body(m), n).otherwise(0))
    return F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of FILTERS and step.

    part, filter_order, step (1 to 5), kept (documents after the step), removed (here), redundant (fail this filter but
    went earlier), unique_fails (fail this filter only), good_lost and toxic_lost (removed here), shapley (what the
    filter removes, summed over all orders).
    """
    masks = range(1 << len(FILTERS))
    counted = flagged(docs, labels).groupBy("part", "good", "toxic").agg(*[F.count_if(F.col("mask") == m).alias(f"m{m}") for m in masks])
    by = {"n": F.lit(True), "g": F.col("good"), "t": F.col("toxic")}
    wide = counted.groupBy("part").agg(*[F.sum(F.when(which, F.col(f"m{m}")).otherwise(0)).alias(f"{name}{m}") for name, which in by.items() for m in masks])
    arrays = wide.select("part", *[F.array(*[f"{name}{m}" for m in masks]).alias(name) for name in by])

    steps = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            before = sum(1 << x for x in order[:k])
            steps.append(F.struct(F.lit("".join(FILTERS[x] for x in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(before).alias("before"), F.lit(1 << f).alias("own")))
    each = arrays.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.filter_order", "s.step", "s.before", "s.own")
    own, before, orders = F.col("own"), F.col("before"), len(steps) // len(FILTERS)
    fails, free = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) == 0
    # Of the filters that a document fails, each comes first in an equal share of all orders.
    share = F.transform(F.col("n"), lambda n, m: F.when(fails(m), n * F.floor(F.lit(orders) / F.bit_count(m))).otherwise(0))
    return each.select(
        "part", "filter_order", "step",
        _over("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"), _over("n", lambda m: fails(m) & free(m)).alias("removed"),
        _over("n", lambda m: fails(m) & ~free(m)).alias("redundant"), _over("n", lambda m: m == own).alias("unique_fails"),
        _over("g", lambda m: fails(m) & free(m)).alias("good_lost"), _over("t", lambda m: fails(m) & free(m)).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )
