"""Metadata catalog: rule-based names, catalog and relation rows, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.sources.tables import union_all


def rule_based_names(columns: DataFrame, tokens: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(column_name, local_name, description) per distinct column name.

    tokens(token, text) may map a token to an empty text, which drops it;
    exceptions(column_name, local_name, description) win over the rule.
    """
    names = columns.select("column_name").distinct()
    words = (
        names.select("column_name", F.posexplode(F.split("column_name", "_")).alias("pos", "token"))
        .where(~F.col("token").rlike("^[0-9]+$"))
        .join(tokens.select("token", "text"), "token", "left")
        .withColumn("text", F.coalesce("text", "token"))
        .where("text <> ''")
    )
    ruled = words.groupBy("column_name").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]),
            " ",
        ).alias("ruled")
    )
    special = exceptions.select(
        "column_name", F.col("local_name").alias("own_name"), F.col("description").alias("own_text")
    )
    local = F.coalesce("own_name", "ruled", "column_name")
    return (
        names.join(ruled, "column_name", "left")
        .join(special, "column_name", "left")
        .select(
            "column_name",
            local.alias("local_name"),
            F.coalesce(
                "own_text", F.format_string(M.RULE_DESCRIPTION, local, F.col("column_name"))
            ).alias("description"),
        )
    )


def catalog_build(
    snapshot: DataFrame, names: DataFrame, overrides: DataFrame, run_ts: Column | None = None
) -> DataFrame:
    """column_spec rows; ``actual_type`` stays beside the declared type.

    overrides(table_id, column_name, declared_type) replace the declared type.
    """
    at = F.lit(None).cast("timestamp") if run_ts is None else run_ts
    return (
        snapshot.join(names, "column_name", "left")
        .join(overrides, ["table_id", "column_name"], "left")
        .select(
            F.concat_ws(".", "table_id", "column_name").alias("column_id"),
            "table_id",
            "column_name",
            F.coalesce("declared_type", "data_type").alias("data_type"),
            F.concat_ws(M.DESCRIPTION_SEPARATOR, "local_name", "description").alias("description"),
            F.lit(None).cast("string").alias("tag"),
            F.lit(None).cast("double").alias("confidence"),
            at.alias("updated_at"),
            F.col("data_type").alias("actual_type"),
            F.col("declared_type").isNotNull().alias("overridden"),
        )
    )


def override_log(catalog: DataFrame) -> DataFrame:
    return catalog.where("overridden").select(
        "table_id", "column_name", "actual_type", F.col("data_type").alias("declared_type")
    )


def table_catalog(counts: DataFrame, source_system: str, run_ts: Column | None = None) -> DataFrame:
    """table_catalog rows from (table_id, row_count)."""
    at = F.lit(None).cast("timestamp") if run_ts is None else run_ts
    return counts.select(
        "table_id",
        F.col("table_id").alias("table_name"),
        F.lit(source_system).alias("source_system"),
        at.alias("registered_at"),
        "row_count",
        F.format_string(M.TABLE_DESCRIPTION, F.col("table_id")).alias("description"),
    )


def relationship_build(
    tables: DataFrame, dimension: str, join_key: str, prefix: str | None = None
) -> DataFrame:
    """One 1:N relation from the dimension to every other table."""
    return tables.where(F.col("table_id") != dimension).select(
        F.concat(F.lit(f"rel_{prefix or dimension}__"), F.col("table_id")).alias("relationship_id"),
        F.lit(dimension).alias("from_table_id"),
        F.col("table_id").alias("to_table_id"),
        F.lit(join_key).alias("join_key"),
        F.lit("1:N").alias("relation_type"),
        F.lit("manual").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
    )


def quality_checks(
    tables: DataFrame,
    columns: DataFrame,
    vectors: DataFrame,
    relationships: DataFrame,
    expected: DataFrame,
    expected_types: DataFrame,
) -> DataFrame:
    """(check_name, expected, actual, passed).

    expected(check_name, expected) names any of: tables, columns, blank_descriptions,
    missing_types, vectors, relationships.  expected_types(column_id, data_type) adds one
    line per column.  Each input is read once.
    """

    def measured(df: DataFrame, **aggs: Column) -> DataFrame:
        one = df.agg(*[a.cast("string").alias(n) for n, a in aggs.items()])
        return one.unpivot([], list(aggs), "check_name", "actual")

    actual = union_all(
        [
            measured(tables, tables=F.count("*")),
            measured(
                columns,
                columns=F.count("*"),
                blank_descriptions=F.count_if(F.coalesce("description", F.lit("")) == ""),
                missing_types=F.count_if(F.col("data_type").isNull()),
            ),
            measured(vectors, vectors=F.count("*")),
            measured(relationships, relationships=F.count("*")),
        ]
    )
    counts = expected.select("check_name", F.col("expected").cast("string").alias("expected")).join(
        actual, "check_name", "left"
    )
    types = expected_types.select("column_id", F.col("data_type").alias("expected")).join(
        columns.select("column_id", F.col("data_type").alias("actual")), "column_id", "left"
    )
    lines = counts.unionByName(
        types.select(F.concat(F.lit("type:"), "column_id").alias("check_name"), "expected", "actual")
    )
    return lines.withColumn("passed", F.col("expected").eqNullSafe(F.col("actual")))


def sample_rows(catalog: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """``n`` seeded random rows, flagged polished when the separator is gone."""
    return (
        catalog.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "column_id").cast("binary")), "column_id")
        .limit(n)
        .select("column_id", "description", (~F.contains("description", F.lit("|"))).alias("polished"))
    )
