"""Matching coverage and route distribution over a labelled set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import strip
from specweave.operators.judge import route
from specweave.operators.strings import fuzzy_topk

ROUTES = {"auto_confirm": "auto", "retry": "retry", "human_confirm": "human"}


def eval_coverage(rows: DataFrame, catalog: DataFrame, group: list[str] | None = None) -> DataFrame:
    """n, exact_hit_rate and fuzzy_additional_hit_rate at four decimals; null when n = 0.

    Names repeat, so they are counted first and matched once.
    """
    keys = group or []
    asked = rows.select(*keys, strip(F.col("eng_name")).alias("eng_name"))
    asked = asked.groupBy(*keys, "eng_name").agg(F.count("*").alias("n"))
    known = catalog.select(F.col("column_name").alias("eng_name")).distinct()
    names = asked.select("eng_name").distinct()
    missed = names.join(known, "eng_name", "left_anti")
    close = fuzzy_topk(missed, catalog, M.EVAL_STRING_TOP_K).select("eng_name").distinct()
    kinds = known.withColumn("kind", F.lit("exact")).unionByName(close.withColumn("kind", F.lit("fuzzy")))
    hits = asked.join(kinds, "eng_name", "left")

    def rate(kind: str):
        part = F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
        return F.round(F.try_divide(part, F.sum("n")), 4)

    return hits.groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        rate("exact").alias("exact_hit_rate"),
        rate("fuzzy").alias("fuzzy_additional_hit_rate"),
    )


def eval_routes(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts of the first attempt: judged(has_candidate, confidence, selected_column_id)."""
    step = F.when(F.col("has_candidate"), route(F.col("confidence"), F.lit(0)))
    return (
        judged.withColumn("step", F.coalesce(step, F.lit("no_candidates")))
        .groupBy(*(group or []))
        .agg(
            F.count("*").alias("evaluated"),
            *[F.count_if(F.col("step") == r).alias(n) for r, n in ROUTES.items()],
            F.count_if(F.col("step") == "no_candidates").alias("no_candidates"),
        )
    )


def threshold_sweep(judged: DataFrame, thresholds: list[tuple[float, float]]) -> DataFrame:
    """Route counts per (auto_at, retry_from) setting from stored judgments, in one pass.

    Judgments are first counted by (confidence, attempt), so the settings multiply the
    distinct confidences and not the rows.
    """
    counted = judged.groupBy("confidence", "attempt").agg(F.count("*").alias("n"))
    settings = F.array(
        *[F.struct(F.lit(a).alias("auto_at"), F.lit(r).alias("retry_from")) for a, r in thresholds]
    )
    step = route(
        F.col("confidence"), F.col("attempt"), auto_at=F.col("t.auto_at"), retry_from=F.col("t.retry_from")
    )
    return (
        counted.withColumn("t", F.explode(settings))
        .withColumn("step", step)
        .groupBy("t.auto_at", "t.retry_from")
        .agg(
            F.sum("n").alias("evaluated"),
            *[F.sum(F.when(F.col("step") == r, F.col("n")).otherwise(0)).alias(n) for r, n in ROUTES.items()],
        )
    )
