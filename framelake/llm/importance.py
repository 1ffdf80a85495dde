r"""Importance resampling towards a target distribution of hashed words.

Documents with the same text are collapsed by grouping on the full text; features, counts and weights are worked out
once for each distinct text, counts are multiplied by the number of copies, and weights are joined back to all documents
before each gets noise of its own.

Words are runs of digits, lowered letters a-z and characters beyond ASCII; features are runs of 1 to ``grams`` words
with one space between them, repeats counted; a feature's bucket is the crc32 of its bytes modulo ``buckets``. With S
features in all documents, s of them in a bucket, and T and t those of the target, the bucket's gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), and a text's weight the sum of the gains of its
features. h is the number that the first 8 hex digits of sha256("<seed>:<doc_id>") write, the noise
floor(-1000 * ln(-ln((h + 0.5) / 2**32))) (Gumbel), and the score weight plus noise. Of the N documents with
``least_words`` words or more, the floor(percent * N / 100) highest scores are drawn, which is sampling without
replacement by weight; ties go to the smaller doc_id.

A null text has no words; without features the weight is 0. A null doc_id has no noise: its score is null, and it is
neither counted in N nor drawn, but its text counts in S. Rows that share a doc_id are scored each by its own text with
the same noise; repeated rows take ranks one after another. No documents give no rows; an empty target has T = t = 0.
Texts of any length count whole, and columns beyond doc_id and text are not looked at.

Groups of copies are combined before the shuffle, gains are one row for each bucket, weights are looked up by
``graph.look_up``, and ranks come from a range partitioning with the sizes of the ranges before, so no group, however
large, is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, drop_tables, let, spaced_words, split_words, write_table
from .graph import look_up
from .license_scan import BETWEEN

GRAMS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10


def _words(text: Column) -> Column:
    return split_words(spaced_words(ascii_lower(text), BETWEEN))


def _runs(words: Column, grams: int) -> Column:
    """All runs of 1 to ``grams`` words."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        # Word by word: a slice would read the whole array for each start.
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))

    return F.concat(words, *map(runs, range(2, grams + 1)))


def _buckets(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """``texts`` (text, ...) with a row for each feature and its bucket instead of the text."""
    rest = [c for c in texts.columns if c != "text"]
    words = _words(F.col("text"))
    runs = texts.select(*rest, F.explode(let(words, lambda w: _runs(w, grams)) if grams > 1 else words).alias("feature"))
    return runs.select(*rest, (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"))


def _gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for every bucket that the source (bucket, n) has; both sides have at most ``buckets`` rows."""
    every = F.col("s_all").cast("double"), F.col("t_all").cast("double")
    totals = source.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).first()[0], target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")).first()[0]
    both = source.withColumnRenamed("n", "s").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")
    both = both.withColumns({"s_all": F.lit(totals[0]), "t_all": F.lit(totals[1])})
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * (every[0] + buckets) / ((s + 1) * (every[1] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, score, ...) with rank: 1, 2, 3 ... by falling score, then doc_id; null beyond ``most``."""
    order = [F.col("score").desc(), F.col("doc_id")]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    placed = write_table(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    # One row for each range, as many as there are shuffle partitions.
    before, offsets = 0, []
    for r in placed.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        offsets.append((r["range"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(offsets, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    numbered = placed.join(F.broadcast(offsets), "range").withColumn("rank", place.cast("long"))
    return numbered.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    same = rows.groupBy("text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    texts = write_table(same, "texts")
    source = write_table(_buckets(texts.select("text", "copies"), grams, buckets).groupBy("bucket").agg(F.sum("copies").alias("n")), "source")
    wanted = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    aim = write_table(_buckets(wanted, grams, buckets).groupBy("bucket").agg(F.count("*").alias("n")), "target")
    gains = _gains(source, aim, buckets)

    sums = _buckets(texts.select("text", "digest"), grams, buckets).join(F.broadcast(gains), "bucket").groupBy("digest").agg(F.count("*").alias("n_features"), F.sum("gain").alias("weight"))
    n_words = F.size(_words(F.col("text")))
    if grams == 1:
        weights = sums.select("digest", F.struct("n_features", F.col("n_features").alias("n_words"), "weight").alias("held"))
    else:
        weights = sums.join(texts.select("digest", n_words.cast("long").alias("n_words")), "digest").select("digest", F.struct("n_features", "n_words", "weight").alias("held"))
    weights = write_table(weights, "weights")

    ids = write_table(rows.select("doc_id", F.sha2("text", 256).alias("digest")), "ids")
    held = look_up(ids, "digest", weights, ids.count(), "held")
    zero = F.lit(0).cast("long")
    scored = held.select("doc_id", *[F.coalesce(f"held.{c}", zero).alias(c) for c in ("n_features", "n_words", "weight")])
    scored = write_table(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    drop_tables(texts, source, aim, weights, ids)
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = ranked(scored.where(able), percent * scored.where(able).count() // 100)
    out = drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
