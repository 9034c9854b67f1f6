"""Reading the given tables, shared folders and small helpers for the operators of this package."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="specweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, **options: Any) -> DataFrame:
    """``df`` cut from its lineage by a table in the shared folder; read again, it is pruned by column."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def shipped(spark: SparkSession, value: Any) -> Broadcast[bytes]:
    """A value for all tasks as bytes that need no module there, as functions do; :func:`opened` in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(sent: Broadcast[bytes]) -> Any:
    return pickle.loads(sent.value)


BROADCAST_ROWS = 1_000_000


def narrowed(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with distinct ids on the column ``ids`` has.

    Up to BROADCAST_ROWS counted ids of fixed width go to every task, so that the texts stay where they are;
    more are joined by shuffle.
    """
    (column,) = ids.columns
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return rows.join(ids, column, how)
