"""The run event log and audit records."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators.numbering import PLACE, RANGE, Keep, in_ranges, range_heads
from specweave.session import shared
from specweave.sources.tables import small_table


def event_sequence(events: DataFrame, starts: DataFrame | None = None, keep: Keep = shared) -> DataFrame:
    """Adds ``seq`` from 0 and ``elapsed_sec`` since the run's previous event.

    events(thread_id, event_id, ts, ...); starts(thread_id, started_at) gives the point
    the first event is measured from.  However many events a run has, of one second as well, no window sees
    more than its events of one range of the log (``numbering``), or one row for each of its ranges.
    """
    placed = in_ranges(events, ["thread_id", "ts", "event_id"], keep)
    heads = range_heads(placed, ["thread_id"], last_ts=F.max("ts"))
    heads = heads.withColumn("_before", F.lag("last_ts").over(Window.partitionBy("thread_id").orderBy(RANGE))).drop("last_ts")
    if starts is not None:
        heads = heads.join(starts.select("thread_id", "started_at"), "thread_id", "left")
        heads = heads.withColumn("_before", F.coalesce("_before", "started_at")).drop("started_at")
    heads = heads.withColumnsRenamed({"first": "_first", "done": "_done"})
    inside = Window.partitionBy("thread_id", RANGE).orderBy(PLACE)
    numbered = placed.withColumn("_prev", F.lag("ts").over(inside)).join(heads, ["thread_id", RANGE])
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.coalesce("_prev", "_before").cast("timestamp")
    )
    return numbered.select(
        *events.columns,
        (F.col(PLACE) - F.col("_first") + F.col("_done")).alias("seq"),
        F.round(micros / 1e6, 2).alias("elapsed_sec"),
    )


def run_status(states: DataFrame) -> DataFrame:
    """(thread_id, status, ts): the latest state(thread_id, ts, event_id, status) per run."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return states.groupBy("thread_id").agg(last.alias("s")).select("thread_id", "s.*")


def events_since(
    sequenced: DataFrame, since: DataFrame, states: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """New events of each polled run: since(thread_id, since) -> seq >= since, with next_since and status.

    A poll without new events gives one row without event.  ``states`` are those of
    ``run_status``; without them, or for a run they do not know, the status is null.
    ``totals(thread_id, n)``, where they are known, save a pass over the numbered log.
    """
    if totals is None:
        totals = sequenced.groupBy("thread_id").agg((F.max("seq") + 1).alias("n"))
    polls = since.select("thread_id", "since").join(totals.select("thread_id", "n"), "thread_id", "left")
    polls = polls.withColumn("next_since", F.coalesce("n", "since")).drop("n")
    if states is None:
        polls = polls.withColumn("status", F.lit(None).cast("string"))
    else:
        polls = polls.join(run_status(states).select("thread_id", "status"), "thread_id", "left")
    tail = sequenced.join(since.select("thread_id", "since"), "thread_id").where(F.col("seq") >= F.col("since"))
    return polls.drop("since").join(tail.drop("since"), "thread_id", "left")


def audit_dedupe(
    records: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("column_id", "question", "answer")
) -> DataFrame:
    """The records whose (column, question, answer) is new, once each (the least by their
    other columns, so that a rerun keeps the same one)."""
    others = [c for c in records.columns if c not in keys]
    fresh = records.select(*keys).distinct()
    if others:
        kept = records.groupBy(*keys).agg(F.min(F.struct(*others)).alias("kept"))
        fresh = kept.select(*[F.col(c) if c in keys else F.col(f"kept.{c}") for c in records.columns])
    known = history.select(*[F.col(k).alias(f"known_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return fresh.join(known, condition, "left_anti")


def node_dictionary(spark) -> DataFrame:
    """The default (node, label, tool, model); replace it by your own table."""
    rows = [(node, label, node, None) for node, label in M.NODE_LABELS.items()]
    return small_table(spark, rows, "node string, label string, tool string, model string")


def node_metadata(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds label, tool and model of each node; an unknown node is its own label and tool.

    The dictionary has one row per kind of node: checked by size, AQE may broadcast it.
    """
    joined = events.join(dictionary.select("node", "label", "tool", "model"), "node", "left")
    known = F.col("label").isNotNull()
    return joined.withColumn("tool", F.when(known, F.col("tool")).otherwise(F.col("node"))).withColumn(
        "label", F.coalesce("label", "node")
    )


def node_summary(events: DataFrame, detail: str = "detail", more: str = "detail2") -> DataFrame:
    """Adds ``summary``: the node's text with its one or two details filled in."""
    texts = F.create_map(*[F.lit(x) for x in chain.from_iterable(M.NODE_SUMMARIES.items())])
    checks = F.create_map(*[F.lit(x) for x in chain.from_iterable(M.EXACT_CHECK_SUMMARIES.items())])
    parts = F.split(F.try_element_at(texts, F.col("node")), "%s")

    def part(i: int):
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))

    def value(name: str, i: int):
        return F.when(F.size(parts) > i, F.coalesce(F.col(name), F.lit(""))).otherwise("")

    filled = F.concat(part(0), value(detail, 1), part(1), value(more, 2), part(2))
    check = F.coalesce(F.try_element_at(checks, F.col(detail)), F.lit(M.EXACT_CHECK_SUMMARIES["false"]))
    return events.withColumn(
        "summary",
        F.when(F.col("node") == "meta_exact_check", check)
        .when(parts.isNull(), M.DEFAULT_SUMMARY)
        .otherwise(filled),
    )
