"""The event log and the audit history kept up to date from files as they arrive.

What a batch has to know of earlier ones, the head of each run and the records already asked, is a table in
buckets (``sources.buckets``): a batch reads and rewrites the buckets of its own keys, whatever the age of the
log.  A batch that is run again after a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specweave.operators.events import audit_dedupe, event_sequence
from specweave.session import Kept
from specweave.sources.buckets import BUCKETS, make_buckets, read_buckets, touched_buckets, write_buckets

_RUN = ["thread_id"]
_HEADS = "thread_id {kind}, n long, last_ts {ts}, batch_id long, n_before long, ts_before {ts}"
_AUDIT = ("column_id", "question", "answer")
Step = Callable[[DataFrame, int], None]


def read_log(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def event_step(events: DataFrame, folder: str, buckets: int = BUCKETS) -> Step:
    """What is done with a batch of events; see :func:`follow_events`."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema, heads_path = _HEADS.format(kind=kinds["thread_id"], ts=kinds["ts"]), f"{folder}/heads"
    make_buckets(events.sparkSession, heads_path, schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = touched_buckets(batch, heads_path, schema, _RUN, buckets)
        # a head that this batch itself has written counts as it was before
        again = F.col("batch_id") == batch_id
        heads = stored.select(
            "thread_id",
            F.when(again, F.col("n_before")).otherwise(F.col("n")).alias("done"),
            F.when(again, F.col("ts_before")).otherwise(F.col("last_ts")).alias("started_at"),
        )
        with Kept(batch.sparkSession) as keep:
            numbered = event_sequence(batch, heads.select("thread_id", "started_at"), keep)
            out = (
                numbered.join(heads.select("thread_id", "done"), "thread_id", "left")
                .withColumn("seq", F.col("seq") + F.coalesce("done", F.lit(0)))
                .drop("done")
            )
            out.write.mode("overwrite").parquet(f"{folder}/events/batch_id={batch_id}")
        new = batch.groupBy("thread_id").agg(F.count("*").alias("more"), F.max("ts").alias("ts"))
        merged = new.join(heads, "thread_id", "left").select(
            "thread_id",
            (F.col("more") + F.coalesce("done", F.lit(0))).alias("n"),
            F.greatest("ts", "started_at").alias("last_ts"),
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.coalesce("done", F.lit(0)).cast("long").alias("n_before"),
            F.col("started_at").alias("ts_before"),
        )
        rest = stored.join(new.select("thread_id"), "thread_id", "left_anti")
        write_buckets(rest.unionByName(merged), heads_path, _RUN, buckets)

    return step


def follow_events(events: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Numbers new events(thread_id, event_id, ts, ...) per run, continuing earlier batches.

    Writes ``folder/events`` with seq and elapsed_sec, one folder a batch, and ``folder/heads``, the count and
    last time of each run.  Files are taken in order of arrival: a later file holds later events of a run.
    """
    step = event_step(events, folder, buckets)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_heads(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """(thread_id, n): how many events of each run are numbered, for ``events_since``."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = _HEADS.format(kind=kinds["thread_id"], ts=kinds["ts"])
    return read_buckets(spark, f"{folder}/heads", schema).select("thread_id", "n")


def audit_step(records: DataFrame, folder: str, keys: tuple[str, ...] = _AUDIT, buckets: int = BUCKETS) -> Step:
    """What is done with a batch of audit records; see :func:`follow_audit`."""
    schema, key = _schema(records), list(keys)
    make_buckets(records.sparkSession, folder, schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        known = touched_buckets(batch, folder, schema, key, buckets)
        write_buckets(known.unionByName(audit_dedupe(batch, known, keys)), folder, key, buckets)

    return step


def follow_audit(
    records: DataFrame, folder: str, checkpoint: str, keys: tuple[str, ...] = _AUDIT, buckets: int = BUCKETS
) -> StreamingQuery:
    """Adds records whose key is new to the table in ``folder`` (:func:`audit_history`).

    Each batch is compared with the stored records of its own buckets; no state grows in the stream itself.
    """
    step = audit_step(records, folder, keys, buckets)
    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_history(spark: SparkSession, folder: str, records: DataFrame) -> DataFrame:
    return read_buckets(spark, folder, _schema(records))
