"""Judgments, routing, retries, confirmations and tag updates.

A judge's replies and a person's decisions are tables.  A row whose reply or decision
is not there yet stays open and is listed for the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import bare, unfenced

ROW = ["spec_id", "row_idx"]


def answers(given: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One answer per key: the latest by ``answered_at`` where there is such a column,
    equal times (or none) settled by the greater text, so that a rerun gives the same."""
    if "answered_at" in given.columns:
        chosen = F.max_by(value, F.struct("answered_at", value))
    else:
        chosen = F.max(value)
    return given.where(F.col(value).isNotNull()).groupBy(*keys).agg(chosen.alias(value))


def judge_request(rows: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """(keys, payload): the source column and its candidates as one JSON text.

    rows carry eng_name, local_name, description and ``candidates``, an array of at most
    top_k structs.
    """
    payload = F.to_json(
        F.struct(
            F.struct("eng_name", "local_name", "description").alias("source_column"),
            F.col("candidates").alias("candidates"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select(*keys, payload.alias("payload"))


def judge_parse(replies: DataFrame, text: str = "response") -> DataFrame:
    """Adds selected_column_id, confidence, evidence, recommend_action, parsed.

    Anything but one JSON object with a numeric confidence gives confidence 0 and
    human_confirm.  Missing keys get confidence 0, empty evidence, human_confirm.
    """
    body = bare(unfenced(F.col(text)))
    # as the only element of an array the text must be one complete value
    single = F.json_array_length(F.concat(F.lit("["), F.col("_body"), F.lit("]"))) == 1
    options = {"columnNameOfCorruptRecord": "corrupt", "allowSingleQuotes": "false"}
    reply = F.from_json("_body", M.JUDGMENT_REPLY, options)
    number = F.col("_reply.confidence").try_cast("double")
    ok = F.coalesce(
        F.startswith("_body", F.lit("{"))
        & F.col("_single")
        & F.col("_reply.corrupt").isNull()
        & (F.col("_reply.confidence").isNull() | (number.isNotNull() & ~F.isnan(number))),
        F.lit(False),
    )
    given = F.when(F.col("_ok"), F.col("_reply"))
    judged = {
        "selected_column_id": given["selected_column_id"],
        "confidence": F.when(
            F.col("_ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
        ).otherwise(F.lit(0.0)),
        "evidence": F.when(F.col("_ok"), F.coalesce(given["evidence"], F.lit("")))
        .otherwise(F.lit(M.EV_BAD_RESPONSE)),
        "recommend_action": F.coalesce(given["recommend_action"], F.lit("human_confirm")),
        "parsed": F.col("_ok"),
    }
    kept = [c for c in replies.columns if c not in judged]
    out = once(replies.select(*kept), _body=body)
    out = once(out, _reply=reply, _single=single)
    out = once(out, _ok=ok)
    return once(out, **judged).drop("_body", "_reply", "_single", "_ok")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that they are computed once.

    A later filter on a plain column is pushed below it with the whole expression copied
    in; it cannot be pushed below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def judge_guard(parsed: DataFrame, candidate_ids: str = "candidate_ids", listed: Column | None = None) -> DataFrame:
    """A selection outside the candidate list is dropped and flagged.

    ``listed``, where it is given, says whether the selection is a candidate; else the array
    ``candidate_ids`` does.
    """
    selected = F.col("selected_column_id")
    if listed is None:
        listed = F.array_contains(candidate_ids, selected)
    outside = selected.isNotNull() & ~F.coalesce(listed, F.lit(False))
    return (
        parsed.withColumn("hallucination_flag", outside)
        .withColumn("confidence", F.when(F.col("hallucination_flag"), 0.0).otherwise(F.col("confidence")))
        .withColumn(
            "evidence",
            F.when(F.col("hallucination_flag"), F.trim(F.concat("evidence", F.lit(M.EV_OUTSIDE_SUFFIX))))
            .otherwise(F.col("evidence")),
        )
        .withColumn(
            "recommend_action",
            F.when(F.col("hallucination_flag"), F.lit("human_confirm")).otherwise(F.col("recommend_action")),
        )
        .withColumn("selected_column_id", F.when(~F.col("hallucination_flag"), selected))
    )


def route(
    confidence: Column,
    attempt: Column,
    selected: Column | None = None,
    auto_at: Column | float = M.AUTO_CONFIRM_AT,
    retry_from: Column | float = M.RETRY_FROM,
) -> Column:
    """auto_confirm, retry or human_confirm.

    With ``selected`` given, a high confidence without a selection goes to a person.
    """
    sure = confidence >= auto_at
    step = F.when(confidence < retry_from, "human_confirm").when(
        attempt < M.MAX_RETRIES, "retry"
    ).otherwise("human_confirm")
    if selected is None:
        return F.when(sure, "auto_confirm").otherwise(step)
    return (
        F.when(sure & selected.isNotNull(), "auto_confirm").when(sure, "human_confirm").otherwise(step)
    )


def retry_params(rows: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Adds top_k, floor and glossary_boost of each row's attempt."""
    n = F.col(attempt)
    return (
        rows.withColumn("top_k", (M.BASE_TOP_K + n * M.TOP_K_STEP).cast("int"))
        .withColumn(
            "floor",
            F.round(F.greatest(F.lit(M.LOWEST_FLOOR), F.lit(M.PREFILTER_FLOOR) - n * M.FLOOR_STEP), 4),
        )
        .withColumn("glossary_boost", n > 0)
    )


def retry_widening(
    rows: DataFrame, candidates: DataFrame, responses: DataFrame, ask: str = "ask_id"
) -> DataFrame:
    """The attempt at which each row leaves the search, with its judgment and candidates.

    rows(spec_id, row_idx, ask_id, ...), candidates(ask_id, attempt, column_id, source,
    score, rank), responses(spec_id, row_idx, attempt, response).  All attempts come from
    one retrieval, so instead of looping every attempt is judged and the first one that
    does not ask for a retry is kept.  ``route`` may also be no_match (no candidate) or
    awaiting_judgment (no reply stored yet).  Attempts are compared by ids alone; candidate
    lists are fetched for the attempt that was chosen.
    """
    ids = candidates.select(ask, "attempt", F.col("column_id").alias("selected_column_id")).distinct()
    some = ids.select(ask, "attempt").distinct().withColumn("has_candidate", F.lit(True))
    replies = answers(responses, [*ROW, "attempt"], "response")
    attempts = F.explode(F.sequence(F.lit(0), F.lit(M.MAX_RETRIES)))
    tried = (
        rows.select(*ROW, ask)
        .withColumn("attempt", attempts)
        .join(some, [ask, "attempt"], "left")
        .join(replies, [*ROW, "attempt"], "left")
    )
    known = ids.withColumn("listed", F.lit(True))
    parsed = judge_parse(tried).join(known, [ask, "attempt", "selected_column_id"], "left")
    judged = judge_guard(parsed, listed=F.col("listed"))
    step = (
        F.when(F.col("has_candidate").isNull(), "no_match")
        .when(F.col("response").isNull(), "awaiting_judgment")
        .otherwise(route(F.col("confidence"), F.col("attempt"), F.col("selected_column_id")))
    )
    outcome = F.struct(
        "attempt", "route", "selected_column_id", "confidence", "evidence",
        "recommend_action", "hallucination_flag",
    )
    # attempts that ask for a retry have no place in the order, so they are never the least
    at = F.when(F.col("route") != "retry", F.col("attempt"))
    last = judged.withColumn("route", step).groupBy(*ROW).agg(F.min_by(outcome, at).alias("o"))
    listed = candidates.groupBy(ask, "attempt").agg(
        F.array_sort(F.collect_list(F.struct("rank", "column_id", "source", "score"))).alias("candidates")
    )
    return rows.join(last.select(*ROW, "o.*"), ROW).join(listed, [ask, "attempt"], "left")


def no_candidate(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without any candidate: unresolved, no_match."""
    return rows.join(candidates.select(*keys).distinct(), keys, "left_anti").select(
        *rows.columns,
        F.lit("unresolved").alias("match_status"),
        F.lit(M.EV_NO_CANDIDATE).alias("match_evidence"),
        F.lit("no_match").alias("unresolved_reason"),
        F.lit("no_match").alias("resolution_path"),
    )


def target_of(rows: DataFrame) -> Column:
    """The judged column, else the first candidate."""
    return F.coalesce("selected_column_id", F.get("candidates", F.lit(0))["column_id"])


def confirmation_queue(rows: DataFrame, decisions: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Rows that wait for a person: no decision stored yet."""
    return rows.join(answers(decisions, keys, "decision"), keys, "left_anti")


def apply_confirmation(rows: DataFrame, decisions: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Adds decision, match_status and confirmation_status.

    approved -> inferred_confirmed, any other decision -> unresolved, none -> pending.
    """
    approved = F.col("decision") == "approved"
    return (
        rows.join(answers(decisions, keys, "decision"), keys, "left")
        .withColumn(
            "match_status",
            F.when(F.col("decision").isNull(), "pending")
            .when(approved, "inferred_confirmed").otherwise("unresolved"),
        )
        .withColumn(
            "confirmation_status",
            F.when(F.col("decision").isNull(), "pending").when(approved, "approved").otherwise("rejected"),
        )
    )


_HELD = 1 << 20  # rows that a task holds; beyond, it hands them on


def _last_of(rows: pa.Table, order: list[str]) -> pa.Table:
    """The last row of each column in ``order``, nulls first."""
    keys = [(c, "ascending") for c in ["column_id", *order]]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    ids = rows.column("column_id")
    changes = pc.not_equal(ids.slice(1), ids.slice(0, max(0, len(ids) - 1))).combine_chunks()
    return rows.filter(pa.concat_arrays([changes, pa.array([True] * min(1, len(ids)), pa.bool_())]))


def last_writes(writes: DataFrame, order: list[str]) -> DataFrame:
    """The last write of each column among those of a task, so that what is left to sort does not grow with the writes."""
    names = list(dict.fromkeys(["column_id", "tag", "confidence", "updated_at", *order]))
    writes = writes.select(*names).where("column_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = None, [], 0
        for batch in batches:
            more.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n >= max(1 << 16, held.num_rows if held else 0):
                held, more, n = _last_of(pa.concat_tables([*([held] if held else []), *more]), order), [], 0
                if held.num_rows >= _HELD:
                    yield from held.to_batches(10_000)
                    held = None
        if held or more:
            yield from _last_of(pa.concat_tables([*([held] if held else []), *more]), order).to_batches(10_000)

    return writes.mapInArrow(run, writes.schema)


def tag_upsert(catalog: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """The catalog after all writes(column_id, tag, confidence, updated_at, <order>).

    The last write per column in ``order`` wins; every column it names is replaced.
    """
    last = last_writes(writes, order).groupBy("column_id").agg(
        F.max_by(F.struct("tag", "confidence", "updated_at"), F.struct(*order)).alias("w")
    )
    hit = F.col("w").isNotNull()
    return catalog.join(last, "column_id", "left").select(
        *[
            F.when(hit, F.col(f"w.{c}")).otherwise(F.col(c)).alias(c)
            if c in ("tag", "confidence", "updated_at") else F.col(c)
            for c in catalog.columns
        ]
    )


def matching_summary(rows: DataFrame, key: str = "match_status") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def match_question(rows: DataFrame) -> Column:
    return F.format_string(M.ASK_MATCH, F.col("eng_name"), F.col("confidence").cast("string"))
