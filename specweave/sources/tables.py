"""Real tables: loading, schema snapshot and row counts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from specweave.model import SNAPSHOT, type_name

Tables = dict[str, DataFrame]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-known rows (schemas, dictionaries) as a local relation: no job, known size."""
    struct = T.StructType.fromDDL(schema)
    kinds = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), struct)


def load_tables(
    spark: SparkSession, sources: dict[str, str], fmt: str = "parquet", **options
) -> Tables:
    """One DataFrame per named source file or folder."""
    return {
        name: spark.read.format(fmt).options(**options).load(path) for name, path in sources.items()
    }


def save_tables(tables: Tables, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Keep the loaded data as named tables of the session catalog."""
    for name, df in tables.items():
        df.write.format(fmt).mode(mode).saveAsTable(name)


def row_counts(tables: Tables) -> DataFrame:
    """(table_id, row_count); each count reads no column, only file footers."""
    return union_all(
        [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_id"), "row_count")
         for t, df in tables.items()]
    )


def catalog_snapshot(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_id, column_name, data_type, ordinal) from schemas: no data is read."""
    rows = [
        (table, field.name, type_name(field.dataType), i)
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields, start=1)
    ]
    return small_table(spark, rows, SNAPSHOT)
