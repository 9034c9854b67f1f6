"""Report rows, labels, statistics and revision records."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions import periods
from specweave.functions.text import blank_to_null, nan_to_null
from specweave.sources.tables import small_table

KEYS = ["spec_id", "row_idx"]
SPEC = ["eng_name", "local_name", "description", "req_period"]


def labelled(key: Column, labels: dict[str, str]) -> Column:
    """Dictionary text; unknown keys pass through."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(table, key), key)


def tag_label(tag: Column, req_period: Column) -> Column:
    unasked = (tag == "full_period") & blank_to_null(req_period).isNull()
    return F.when(unasked, M.FULL_PERIOD_NO_REQUEST_LABEL).otherwise(labelled(tag, M.TAG_LABELS))


def label_map(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "tag_label", tag_label(F.col("final_tag"), F.col("req_period"))
    ).withColumn("path_label", labelled(F.col("resolution_path"), M.PATH_LABELS))


def period_format(rows: DataFrame) -> DataFrame:
    return rows.withColumn("avail_period", periods.render(F.col("final_start"), F.col("final_end")))


def report_union(classified: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Validated rows and unresolved rows in one schema.

    req_type is the catalog's type for validated rows and the requested type for
    unresolved ones; ``asked_type`` is always the requested one.
    """
    auto = F.coalesce(F.col("resolution_path") == "auto_confirmed", F.lit(False))
    judged = F.when(auto & (F.col("llm_evidence") != ""), F.concat(F.lit(M.EV_AUTO_PREFIX), "llm_evidence"))
    done = classified.select(
        *KEYS, *SPEC,
        F.col("spec_type").alias("req_type"),
        F.col("actual_type").alias("avail_type"),
        periods.render(F.col("final_start"), F.col("final_end")).alias("avail_period"),
        F.col("table_id").alias("source_table"),
        "final_tag",
        F.concat_ws(" | ", judged, "evidence").alias("evidence"),
        F.when(auto, "auto_confirmed").otherwise("validated").alias("resolution_path"),
        F.col("req_type").alias("asked_type"),
        "column_id",
    )
    none = F.lit(None).cast("string")
    ended = unresolved.select(
        *KEYS, *SPEC,
        "req_type",
        none.alias("avail_type"),
        none.alias("avail_period"),
        none.alias("source_table"),
        F.lit("unresolved").alias("final_tag"),
        F.col("match_evidence").alias("evidence"),
        F.coalesce("unresolved_reason", F.lit("no_match")).alias("resolution_path"),
        F.col("req_type").alias("asked_type"),
        none.alias("column_id"),
    )
    return done.unionByName(ended)


def report_rows(classified: DataFrame) -> DataFrame:
    """The rows of ``report_union`` from one table that holds validated and unresolved rows
    together, so that nothing is computed twice; rows without a tag yet are left out."""
    ended = F.col("match_status") == "unresolved"
    auto = F.coalesce(F.col("resolution_path") == "auto_confirmed", F.lit(False))
    judged = F.when(auto & (F.col("llm_evidence") != ""), F.concat(F.lit(M.EV_AUTO_PREFIX), "llm_evidence"))
    done = F.when(~ended, F.lit(True))
    return classified.where(ended | F.col("final_tag").isNotNull()).select(
        *KEYS, *SPEC,
        F.when(ended, F.col("req_type")).otherwise(F.col("spec_type")).alias("req_type"),
        F.when(done, F.col("actual_type")).alias("avail_type"),
        F.when(done, periods.render(F.col("final_start"), F.col("final_end"))).alias("avail_period"),
        F.when(done, F.col("table_id")).alias("source_table"),
        F.when(ended, "unresolved").otherwise(F.col("final_tag")).alias("final_tag"),
        F.when(ended, F.col("match_evidence")).otherwise(F.concat_ws(" | ", judged, "evidence")).alias("evidence"),
        F.when(ended, F.coalesce("unresolved_reason", F.lit("no_match")))
        .when(auto, "auto_confirmed").otherwise("validated").alias("resolution_path"),
        F.col("req_type").alias("asked_type"),
        F.when(done, F.col("column_id")).alias("column_id"),
    )


def run_results(reports: DataFrame, run_id: str | None = None) -> DataFrame:
    """The stored report rows of a run with their tag text, NaN as null.

    ``run_id`` should be the partition column, then only that run is read.
    """
    rows = reports if run_id is None else reports.where(F.col("run_id") == run_id)
    floats = {f.name for f in rows.schema if f.dataType.simpleString() in ("double", "float")}
    clean = rows.select(
        *[nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns]
    )
    return clean.withColumn("tag_label", tag_label(F.col("final_tag"), F.col("req_period")))


def summary_stats(report: DataFrame) -> DataFrame:
    """(kind, key, n): total, tag and path counts and the auto-confirm count.

    Rows are counted once per (tag, path); the four kinds come from those few counts.
    """
    pairs = report.groupBy("final_tag", "resolution_path").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    auto = F.when(F.col("resolution_path") == "auto_confirmed", F.col("n")).otherwise(0)

    def line(kind: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))

    lines = pairs.select(
        F.inline(
            F.array(
                line("tag", F.col("final_tag"), F.col("n")),
                line("path", F.col("resolution_path"), F.col("n")),
                line("total", none, F.col("n")),
                line("auto_confirm", none, auto),
            )
        )
    )
    # an empty report still has a total
    zero = [("total", None, 0), ("auto_confirm", None, 0)]
    start = small_table(report.sparkSession, zero, "kind string, key string, n long")
    return lines.unionByName(start).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def revision_records(report: DataFrame, previous: DataFrame | None, at: Column) -> DataFrame:
    """revision_history lines: (column_id, before_tag, after_tag, reason, created_at).

    ``previous(column_id, tag)`` is the catalog before the run.  Without a catalog column
    the requested name stands in.
    """
    rows = report
    if previous is not None:
        before = previous.select("column_id", F.col("tag").alias("before_tag"))
        rows = rows.join(before, "column_id", "left")
    else:
        rows = rows.withColumn("before_tag", F.lit(None).cast("string"))
    return rows.select(
        F.coalesce("column_id", "eng_name").alias("column_id"),
        "before_tag",
        F.col("final_tag").alias("after_tag"),
        F.concat(F.lit("resolution_path="), "resolution_path").alias("reason"),
        at.alias("created_at"),
    )


def auto_confirm_records(resolved: DataFrame, at: Column) -> DataFrame:
    """auto_confirm_log lines of the rows confirmed without a person."""
    return resolved.where("match_status = 'auto_confirmed'").select(
        "column_id", "eng_name",
        F.col("llm_confidence").alias("confidence"),
        F.col("llm_evidence").alias("evidence"),
        at.alias("created_at"),
    )


def confirmation_records(asked: DataFrame, question: Column, answer: str, at: Column) -> DataFrame:
    """qna_history lines; pass them through ``events.audit_dedupe`` before appending."""
    return asked.where(F.col(answer).isNotNull()).select(
        "column_id",
        F.lit("confirmation").alias("interaction_type"),
        question.alias("question"),
        F.col(answer).alias("answer"),
        F.lit(1).alias("round_no"),
        at.alias("created_at"),
    )
