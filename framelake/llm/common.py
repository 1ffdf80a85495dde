"""Shared plumbing of the corpus operators: inputs, scratch tables, Arrow slicing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.sources.scratch import drop_tables, shared_dir, write_table  # noqa: F401  (for the operators)

#: Rows of one Arrow batch sent to Python; texts can be long, so batches stay short.
ARROW_ROWS = 512
#: Text bytes handled by the numpy kernels at once.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_key(text: Column) -> Column:
    """A hash of the text (null: 0) that tells rows of one id apart; only ever joined on together with the id."""
    return F.coalesce(F.xxhash64(F.lit("text"), text.cast("string")), F.lit(0)).cast("long")


def own_name(columns: list[str], stem: str) -> str:
    """A column name that is not among ``columns``, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, text_key) stands in ``bad`` (doc_id, key); null ids stay."""
    one, two = own_name(docs.columns, "bad_id"), own_name(docs.columns, "bad_key")
    gone = bad.select(F.col("doc_id").alias(one), F.col("key").alias(two)).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(one)) & (text_key(F.col("text")) == F.col(two)), "left_anti")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (string or binary) holds about ``most`` bytes in each."""
    for batch in batches:
        start, total = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def told_apart(rows: DataFrame, key: str, *digests: str) -> DataFrame:
    """``rows`` (a written table) with a ``key`` (a 64-bit hash) that is another one for rows with other ``digests``.

    Keys that rows with different digests share are looked for in all rows. They are a handful in a hundred thousand
    million rows, if any; all but the least digests of such a key get a new one, until no key is shared.
    """
    own = F.struct(*digests)
    salt = 0
    while True:
        shared = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(own).alias("low_"), F.max(own).alias("high_")).where("low_ <> high_").select(F.col(key).alias("shared_"), "low_").collect()
        if not shared:
            return rows
        salt += 1
        known = rows.sparkSession.createDataFrame(shared, rows.select(F.col(key).alias("shared_"), own.alias("low_")).schema)
        other = F.col("shared_").isNotNull() & (own != F.col("low_"))
        fresh = F.when(other, F.xxhash64(F.lit(salt), *digests)).otherwise(F.col(key))
        told = rows.join(F.broadcast(known), F.col(key) == F.col("shared_"), "left").withColumn("fresh_", fresh)
        rows = write_table(told.select(*[F.col("fresh_").alias(c) if c == key else F.col(c) for c in rows.columns]), "told")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and nothing else changed."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def spaced_words(text: Column, between: str) -> Column:
    """The words of ``text`` with one space between them; ``between`` is a class of the characters that no word holds."""
    return F.trim(F.regexp_replace(text, f"[{between}]+", " "))


def split_words(spaced: Column) -> Column:
    """The array of words of ``spaced_words``; an empty one where there is none."""
    return F.when(spaced != "", F.split(spaced, " ", -1)).otherwise(F.array().cast("array<string>"))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
