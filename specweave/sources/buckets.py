"""Stored tables that are changed in place: cut into buckets by a hash of their key.

A change reads and rewrites only the buckets its keys fall into; all other files stay as they are.  Spark
replaces the touched partitions when the write commits, so what is read there may be rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # size it so that a bucket is some 100 MB


def _cut(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, path: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Write ``df``; buckets it has rows for are replaced, others stay."""
    out = _cut(df, key, buckets).repartition("bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def make_buckets(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table where there is none, so that reading never meets a missing path."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/bucket=-1")


def read_buckets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole table."""
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def touched_buckets(
    changes: DataFrame, path: str, schema: str, key: list[str], buckets: int = BUCKETS
) -> DataFrame:
    """What is stored in the buckets of the keys of ``changes``; the scan opens no other file."""
    numbers = [r.bucket for r in _cut(changes.select(*key), key, buckets).select("bucket").distinct().collect()]
    stored = changes.sparkSession.read.schema(f"{schema}, bucket int").parquet(path)
    return stored.where(F.col("bucket").isin(numbers)).drop("bucket")


def upsert_buckets(
    changes: DataFrame,
    path: str,
    schema: str,
    key: list[str],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> None:
    """Replace the touched buckets by ``merge(stored rows of those buckets, changes)``.

    ``merge`` returns all rows of these buckets and no other.  Where it is idempotent, as an update by value is,
    a change that is repeated after a failure leaves the same table.
    """
    stored = touched_buckets(changes, path, schema, key, buckets)
    write_buckets(merge(stored, changes), path, key, buckets)
