"""Writers: strict JSON, lines, CSV and short reports. NaN never leaves: it becomes null."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def _clean(value: Column, kind: DataType) -> Column:
    if isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return value


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, at any depth."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    strict(df).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON line a row, sorted within and across the files."""
    strict(df).orderBy(*order).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def box_lines(boxes: DataFrame) -> DataFrame:
    """video,sec,x1,y1,x2,y2,label,score with fixed places, seconds in four digits."""
    return boxes.select(F.format_string("%s,%04d,%.3f,%.3f,%.3f,%.3f,%d,%.4f", "video", "sec", "x1", "y1", "x2", "y2", "label", "score").alias("value"))


def write_boxes(boxes: DataFrame, path: str) -> None:
    box_lines(boxes).write.mode("overwrite").text(path)


def report(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A table in HTML of the first rows; the report is for people and stops at ``most`` rows."""
    cells = rows.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in cells)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def manifest(stages: DataFrame) -> DataFrame:
    """Latest status of each stage of each segment, from appended rows (segment, stage, status, at, digest)."""
    return stages.groupBy("segment", "stage").agg(F.max_by(F.struct("status", "digest"), "at").alias("s"), F.count("*").alias("runs")).select("segment", "stage", "s.*", "runs")
