"""Building catalog, relations and glossary from the real tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from specweave.operators import catalog as cat
from specweave.operators import glossary
from specweave.sources.tables import Tables, catalog_snapshot, row_counts


@dataclass
class Metadata:
    table_catalog: DataFrame
    column_spec: DataFrame
    overrides: DataFrame
    relationships: DataFrame
    glossary_drafts: DataFrame


def bootstrap(
    spark: SparkSession,
    tables: Tables,
    tokens: DataFrame,
    exceptions: DataFrame,
    overrides: DataFrame,
    dimension: str,
    join_key: str,
    source_system: str,
    run_ts: Column,
    terms: DataFrame | None = None,
) -> Metadata:
    """Rule-based metadata of all tables; polishing, review and vectors follow as tables
    that come back from outside (``operators.glossary``)."""
    snapshot = catalog_snapshot(spark, tables)
    counts = row_counts(tables)
    names = cat.rule_based_names(snapshot, tokens, exceptions)
    columns = cat.catalog_build(snapshot, names, overrides, run_ts)
    return Metadata(
        table_catalog=cat.table_catalog(counts, source_system, run_ts),
        column_spec=columns.drop("actual_type", "overridden"),
        overrides=cat.override_log(columns),
        relationships=cat.relationship_build(
            snapshot.select("table_id").distinct(), dimension, join_key
        ),
        glossary_drafts=glossary.glossary_seed(columns, terms, run_ts),
    )
