"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.

Every stage takes null, empty and very long texts, null ids, ids that several rows share and an empty table:
the first stage drops texts without letters (null and empty ones too); after it rows with a null id are never
dropped nor cut; rows that share an id are judged each by its own text; no rows give no rows. Repeated rows
stay or go alike. Columns beyond those of documents stay up to the last stage, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, langid, line_dedup, minhash, mixing
from framelake.llm.common import drop_tables, read_table, without_rows, write_table


#: Least lead of a language over the next one (score), and characters from which a text must show it.
LEAD, CHARS = 0.05, 40


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language.

    Texts without any letter go, and so do those of CHARS characters or more whose best language needs not even
    LEAD fewer phrases than the next one: no language parses them better than another. Shorter texts say too little
    to be rejected. Where no language could be learned, only texts without letters go.
    """
    unclear = langid.identify(docs.where(F.length("text") >= CHARS)).where((F.col("lang_pred") != "und") & (F.col("score") < LEAD))
    return without_rows(docs.where(F.col("text").rlike(r"\p{L}")), unclear.select("doc_id", "key")).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the later one; n_chars follows."""
    done = line_dedup.remove_common_blocks(docs)
    lines_in, lines_out = done.columns[:2]
    cut = F.col(lines_out) < F.col(lines_in)
    return done.select(*[F.when(cut, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; rows that share an id are judged one by one."""
    return without_rows(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id", "key")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows that share an id are judged one by one."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of every document that the mix takes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]
#: SQL can express neither the parse of stage 1 nor the rounding of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_tables(before)
        before = docs
    return docs
