"""Checks of matched columns against the real tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.periods import month_of
from specweave.operators.judge import answers
from specweave.sources.tables import Tables, small_table, union_all

# table -> (column, month expression); the expression must not decrease with the column
Months = dict[str, tuple[str, Callable[[Column], Column]]]


def months(columns: dict[str, str], expression: Callable[[Column], Column] = month_of) -> Months:
    return {table: (column, expression) for table, column in columns.items()}


def validation_scope(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("match_status").isin(M.VALIDATED_STATUSES))


def column_exists(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds ``exists`` and ``actual_type`` of (table_id, column_name) in the real tables."""
    real = snapshot.select("table_id", "column_name", F.col("data_type").alias("actual_type"))
    return rows.join(real, ["table_id", "column_name"], "left").withColumn(
        "exists", F.col("actual_type").isNotNull()
    )


def type_compare(rows: DataFrame) -> DataFrame:
    """Adds ``type_equal``: declared against actual type, upper-cased; null if not there."""
    same = F.upper("spec_type").eqNullSafe(F.upper("actual_type"))
    return rows.withColumn("type_equal", F.when(F.col("exists"), same))


def type_confirmation(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Adds final_type and type_match_status.

    Equal types are ``matched``; else approved -> actual type, any other decision ->
    declared type; without a decision ``pending``.
    """
    latest = answers(decisions, keys, "decision").withColumnRenamed("decision", "type_decision")
    differs = F.col("exists") & ~F.col("type_equal")
    approved = F.col("type_decision") == "approved"
    return (
        rows.join(latest, keys, "left")
        .withColumn(
            "type_match_status",
            F.when(~F.coalesce("exists", F.lit(False)), F.lit(None).cast("string"))
            .when(F.col("type_equal"), "matched")
            .when(F.col("type_decision").isNull(), "pending")
            .when(approved, "mismatch_confirmed")
            .otherwise("mismatch_rejected"),
        )
        .withColumn("type_decision", F.when(differs, F.col("type_decision")))
        .withColumn(
            "final_type",
            F.when(F.col("type_match_status").isin("matched", "mismatch_confirmed"), F.col("actual_type"))
            .when(F.col("type_match_status") == "mismatch_rejected", F.col("spec_type")),
        )
    )


def type_queue(rows: DataFrame) -> DataFrame:
    """Type questions without an answer."""
    return rows.where("type_match_status = 'pending'")


def retention_period(
    tables: Tables, month_columns: Months, only: Iterable[str] | None = None
) -> DataFrame:
    """(table_id, ret_start, ret_end): first and last month held per table.

    One aggregate per table that reads the month column alone.  As the month expression
    does not decrease, it is applied to the minimum and maximum, not to every row.
    """
    wanted = set(tables) if only is None else set(only)
    parts = []
    for table, df in tables.items():
        if table not in wanted or table not in month_columns:
            continue
        column, month = month_columns[table]
        parts.append(
            df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).select(
                F.lit(table).alias("table_id"),
                month(F.col("lo")).cast("int").alias("ret_start"),
                month(F.col("hi")).cast("int").alias("ret_end"),
            )
        )
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return small_table(spark, [], "table_id string, ret_start int, ret_end int")
    return union_all(parts)


def add_retention(rows: DataFrame, retention: DataFrame) -> DataFrame:
    """Adds ret_start, ret_end of existing columns (retention: one row per table)."""
    found = rows.join(retention, "table_id", "left")
    return found.withColumn("ret_start", F.when(F.col("exists"), F.col("ret_start"))).withColumn(
        "ret_end", F.when(F.col("exists"), F.col("ret_end"))
    )


def row_cap(df: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """The first ``rows`` rows in ``order``, for a look at a table; no plan cuts rows itself."""
    return df.orderBy(*order).limit(rows)


def type_question(rows: DataFrame) -> Column:
    return F.format_string(
        M.ASK_TYPE, F.col("column_id"), F.col("spec_type"), F.col("actual_type")
    )
