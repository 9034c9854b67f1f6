"""Final tags: existence, then type, then period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions import periods
from specweave.operators.judge import once

BAD_PERIOD = "bad_period"


def period_parse(rows: DataFrame, text: str = "req_period") -> DataFrame:
    """Adds req_start, req_end and ``bad_period`` (two parts, one of them no integer)."""
    added = ("req_start", "req_end", BAD_PERIOD)
    split = once(rows.select(*(c for c in rows.columns if c not in added)), _parts=periods.parts(F.col(text)))
    start, end, bad = periods.parse(F.col("_parts"))
    return once(split, **dict(zip(added, (start, end, F.coalesce(bad, F.lit(False)))))).drop("_parts")


def period_compare(rows: DataFrame) -> DataFrame:
    """Adds period_tag, final_start, final_end and period_evidence."""
    c = periods.compare(*[F.col(x) for x in ("req_start", "req_end", "ret_start", "ret_end")])
    added = {"period_tag": c["tag"], "final_start": c["start"], "final_end": c["end"], "period_evidence": c["evidence"]}
    return once(rows.select(*(x for x in rows.columns if x not in added)), **added)


def classify(rows: DataFrame) -> DataFrame:
    """Adds final_tag, evidence, final_start, final_end and reject_reason.

    A row has no tag when its column was not checked (``exists`` is null), while its type
    question is open, or when its period text is bad and the period would decide (then
    reject_reason says so).
    """
    checked = period_compare(period_parse(rows))
    status = F.col("type_match_status")
    seen = F.col("exists").isNotNull()
    missing = ~F.col("exists")
    refused = F.coalesce(status == "mismatch_rejected", F.lit(False))
    open_type = F.coalesce(status == "pending", F.lit(False))
    bad = F.col(BAD_PERIOD)

    def pick(not_found: Column, type_off: Column, period: Column) -> Column:
        nothing = F.lit(None)
        return (
            F.when(~seen, nothing).when(missing, not_found).when(refused, type_off)
            .when(open_type | bad, nothing).otherwise(period)
        )

    none = F.lit(None).cast("int")
    prefix = F.when(
        status == "mismatch_confirmed", F.format_string(M.EV_TYPE_CONFIRMED, F.col("actual_type"))
    ).otherwise("")
    out = (
        checked.withColumn(
            "final_tag", pick(F.lit("not_found"), F.lit("type_mismatch"), F.col("period_tag"))
        )
        .withColumn(
            "evidence",
            pick(F.lit(M.EV_NOT_FOUND), F.lit(M.EV_TYPE_MISMATCH), F.concat(prefix, F.col("period_evidence"))),
        )
        .withColumn("final_start", pick(none, none, F.col("final_start")))
        .withColumn("final_end", pick(none, none, F.col("final_end")))
        .withColumn("reject_reason", F.when(seen & ~missing & ~refused & ~open_type & bad, F.lit(BAD_PERIOD)))
    )
    return out.drop("period_tag", "period_evidence", BAD_PERIOD)


def tagged(classified: DataFrame) -> DataFrame:
    return classified.where("final_tag is not null")


def rejects(classified: DataFrame) -> DataFrame:
    return classified.where("reject_reason is not null")


def tag_writes(classified: DataFrame, at: Column, stage: int = 1) -> DataFrame:
    """The catalog writes of this step, for ``judge.tag_upsert`` ordered by
    (stage, spec_id, row_idx)."""
    return tagged(classified).select(
        "column_id", F.col("final_tag").alias("tag"), F.lit(1.0).alias("confidence"),
        at.alias("updated_at"), F.lit(stage).alias("stage"), "spec_id", "row_idx",
    )


def validation_log(classified: DataFrame, at: Column) -> DataFrame:
    """One audit line per validated column."""
    return classified.where("column_id is not null and exists is not null").select(
        "column_id", "spec_type", "actual_type",
        (F.col("type_match_status") == "matched").alias("is_match"),
        "final_tag", at.alias("created_at"),
    )
