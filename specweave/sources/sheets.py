"""Specification sheets and header CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.operators.spec import drop_empty_rows


def spec_grid_scan(cells: DataFrame) -> DataFrame:
    """(spec_id, row_idx, cells) without the rows in which every cell is null."""
    return drop_empty_rows(cells.select("spec_id", "row_idx", "cells"))


def as_cells(
    df: DataFrame, spec_id: str, row_idx: str, columns: list[str]
) -> DataFrame:
    """A wide untyped sheet as one array of text per row."""
    return df.select(
        F.col(spec_id).alias("spec_id"),
        F.col(row_idx).cast("long").alias("row_idx"),
        F.array(*[F.col(c).cast("string") for c in columns]).alias("cells"),
    )


def read_csv_with_header(spark: SparkSession, path: str, **options) -> DataFrame:
    """A header CSV as text columns; a byte-order mark is not part of the first name.

    Fields may hold line breaks, so files are not split inside (they are one sheet each).
    """
    df = (
        spark.read.options(multiLine=True, escape='"', encoding="UTF-8", **options)
        .csv(path, header=True, inferSchema=False)
    )
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review file as ``glossary.review_apply`` takes it: lists split at commas, blank ones empty."""
    rows = read_csv_with_header(spark, path)

    def listed(name: str):
        parts = F.transform(F.split(F.coalesce(name, F.lit("")), ","), lambda x: F.trim(x))
        return F.filter(parts, lambda x: x != "").alias(name)

    return rows.select(
        *[listed(c) if c in ("original_synonyms", "suggested_synonyms") else F.col(c) for c in rows.columns]
    )
