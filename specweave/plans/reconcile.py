"""The whole reconciliation of parsed specification rows, as one chain of DataFrames.

Nothing blocks: what still needs a judge or a person comes out as a table of open
questions, and the next run is given the answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import is_blank, strip
from specweave.operators import classify as C
from specweave.operators import judge as J
from specweave.operators import match, report, strings, vectors
from specweave.operators import validate as V

ROW = J.ROW
SPEC = [*ROW, *M.SPEC_FIELDS]


@dataclass
class Reconciliation:
    """All outputs of one run."""

    candidates: DataFrame       # (ask_id, attempt, column_id, source, score, rank)
    resolved: DataFrame         # every row with its match_status, pending included
    open_vectors: DataFrame     # descriptions without a vector yet; their rows stay pending
    open_judgments: DataFrame   # (spec_id, row_idx, attempt, payload)
    open_matches: DataFrame     # rows waiting for a person's yes or no
    open_types: DataFrame       # type questions waiting for an answer
    classified: DataFrame       # validated rows with final_tag, evidence, period
    rejects: DataFrame          # rows without a tag: bad period text
    report: DataFrame           # report rows, labels included
    summary: DataFrame          # (kind, key, n)
    tag_writes: DataFrame       # ordered catalog writes of this run
    revisions: DataFrame        # revision_history lines
    auto_confirms: DataFrame    # auto_confirm_log lines
    confirmations: DataFrame    # qna_history lines, before de-duplication
    validations: DataFrame      # validation_log lines


def ask_key(rows: DataFrame) -> Column:
    """Rows with one name and one description ask the same question; a null is not an empty text."""
    asked = F.struct(strip(F.col("eng_name")).alias("name"), F.col("description").alias("text"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}).cast("binary"), 256)


def find_candidates(
    asks: DataFrame,
    catalog: DataFrame,
    description_vectors: DataFrame,
    column_vectors: DataFrame,
    terms: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
    string_keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    **vector_options,
) -> DataFrame:
    """Candidates of all attempts from one retrieval at the widest limits.

    asks(ask_id, eng_name, description) are distinct.  Vectors are searched once per
    distinct description, strings once per distinct name.
    description_vectors(description, embedding).
    """
    wide = match.widest()
    limit, floor = wide["vector_limit"], wide["floor"]
    texts = asks.select("description").distinct()
    queries = texts.join(description_vectors.select("description", "embedding"), "description").select(
        F.sha2("description", 256).alias("query_id"), "embedding"
    )
    keys = asks.select("ask_id", F.sha2("description", 256).alias("query_id"))

    def near(found: DataFrame, source: str) -> DataFrame:
        return found.join(keys, "query_id").select(
            "ask_id", "column_id", F.lit(source).alias("source"),
            F.col("similarity").alias("score"), F.col("vector_rank").alias("place"),
        )

    hits = near(
        vectors.vector_topk_columns(queries, column_vectors, catalog, limit, floor, **vector_options),
        "vss_column",
    )
    if terms is not None and term_vectors is not None:
        hits = hits.unionByName(
            near(
                vectors.vector_topk_glossary(
                    queries, term_vectors, terms, catalog, limit, floor, **vector_options
                ),
                "vss_glossary",
            )
        )
    named = strings.fuzzy_topk(asks.select("eng_name"), catalog, wide["top_k"], wide["string_cut"], keep=string_keep)
    spelled = named.join(asks.select("ask_id", "eng_name"), "eng_name").select(
        "ask_id", "column_id", F.lit("fuzzy").alias("source"), "score", F.col("string_rank").alias("place")
    )
    return match.candidate_merge(hits.unionByName(spelled))


def resolve(
    rows: DataFrame, candidates: DataFrame, responses: DataFrame, decisions: DataFrame
) -> DataFrame:
    """Rows without exact match after judgment and confirmation.

    Adds attempt, route, target_id, match_status, match_evidence, resolution_path,
    unresolved_reason, llm_confidence, llm_evidence, decision.
    """
    left = J.retry_widening(rows, candidates, responses).withColumn("target_id", J.target_of(rows))
    asked = J.apply_confirmation(left, decisions)
    step = F.col("route")
    person = step == "human_confirm"
    status = (
        F.when(step == "auto_confirm", "auto_confirmed")
        .when(step == "no_match", "unresolved")
        .when(step == "awaiting_judgment", "pending")
        .otherwise(F.col("match_status"))
    )
    none = F.lit(None).cast("string")
    settled = asked.withColumn("match_status", status)
    refused = person & (F.col("match_status") == "unresolved")
    confirmed = F.col("match_status").isin("auto_confirmed", "inferred_confirmed")
    return (
        settled.withColumn("decision", F.when(person, F.col("decision")))
        .withColumn(
            "match_evidence",
            F.when(step == "no_match", M.EV_NO_CANDIDATE).when(refused, M.EV_REJECTED)
            .when(confirmed, F.col("evidence")),
        )
        .withColumn(
            "resolution_path",
            F.when(step == "auto_confirm", "auto_confirmed").when(step == "no_match", "no_match")
            .when(refused, "rejected_by_human").when(confirmed, "validated"),
        )
        .withColumn(
            "unresolved_reason",
            F.when(step == "no_match", "no_match").when(refused, "rejected_by_human").otherwise(none),
        )
        .withColumn("llm_confidence", F.when(confirmed, F.col("confidence")))
        .withColumn("llm_evidence", F.when(confirmed, F.col("evidence")))
    )


def check_columns(
    rows: DataFrame, snapshot: DataFrame, type_decisions: DataFrame, retention: DataFrame
) -> DataFrame:
    """Existence, type and held months of rows(match_status, table_id, column_name,
    spec_type, ...).  Unresolved and pending rows name no column: they skip the joins and
    come out with ``exists`` null."""
    found = V.column_exists(V.validation_scope(rows), snapshot)
    typed = V.type_confirmation(V.type_compare(found), type_decisions, ROW)
    checked = V.add_retention(typed, retention)
    rest = rows.where(~F.coalesce(F.col("match_status").isin(M.VALIDATED_STATUSES), F.lit(False)))
    return checked.unionByName(rest, allowMissingColumns=True)


def exact_rows(found: DataFrame) -> DataFrame:
    """Rows of ``match.exact_match`` in the shape of a match result: matched or no_match."""
    hit = F.col("n_matches") > 0
    none = F.lit(None).cast("string")
    return found.select(
        *SPEC,
        F.col("match_column_id").alias("column_id"),
        F.col("match_table_id").alias("table_id"),
        F.col("match_column_name").alias("column_name"),
        F.col("match_data_type").alias("spec_type"),
        F.when(hit, "matched").otherwise("unresolved").alias("match_status"),
        F.when(hit, M.EV_EXACT).otherwise(M.EV_NO_CANDIDATE).alias("match_evidence"),
        F.when(hit, "validated").otherwise("no_match").alias("resolution_path"),
        F.when(~hit, "no_match").alias("unresolved_reason"),
        F.lit(None).cast("double").alias("llm_confidence"),
        none.alias("llm_evidence"),
    )


def searched_rows(resolved: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of ``resolve`` in the shape of a match result; unresolved ones name no column."""
    confirmed = F.col("match_status").isin("auto_confirmed", "inferred_confirmed")
    picked = resolved.withColumn("column_id", F.when(confirmed, F.col("target_id")))
    looked = match.column_lookup(picked, catalog)
    return looked.select(
        *SPEC, "column_id",
        F.col("meta_table_id").alias("table_id"),
        F.col("meta_column_name").alias("column_name"),
        F.col("meta_data_type").alias("spec_type"),
        "match_status", "match_evidence", "resolution_path", "unresolved_reason",
        "llm_confidence", "llm_evidence",
    )


def waiting_rows(rows: DataFrame) -> DataFrame:
    """Rows whose description has no vector yet, in the shape of a match result: pending."""
    none = F.lit(None).cast("string")
    empty = ["column_id", "table_id", "column_name", "spec_type"]
    return rows.select(
        *SPEC,
        *[none.alias(c) for c in empty],
        F.lit("pending").alias("match_status"),
        *[none.alias(c) for c in ("match_evidence", "resolution_path", "unresolved_reason")],
        F.lit(None).cast("double").alias("llm_confidence"),
        none.alias("llm_evidence"),
    )


def open_judgments(resolved: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Payloads for the judge; candidate details are looked up once per question."""
    waiting = resolved.where("route = 'awaiting_judgment'").drop("candidates")
    wanted = waiting.select("ask_id", "attempt").distinct()
    details = (
        candidates.join(wanted, ["ask_id", "attempt"])
        .join(catalog.select("column_id", "column_name", "table_id", "description"), "column_id")
        .groupBy("ask_id", "attempt")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "column_id", "column_name", "table_id", "description", "source", "score")
                )
            ).alias("candidates")
        )
    )
    return J.judge_request(waiting.join(details, ["ask_id", "attempt"]), [*ROW, "attempt"])


def filled_vectors(texts: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``description, embedding``: the given vectors, and what ``embed`` makes of the other texts.

    ``embed`` sees each text without vector once, as ``description``, and returns ``description, embedding``;
    texts that it leaves out, or gives null, stay without.  Of several vectors of a text the least counts.
    """
    known = vectors.where("embedding is not null").select("description", "embedding")
    asked = texts.where(~is_blank(F.col("description"))).select("description").distinct()
    made = embed(asked.join(known, "description", "left_anti")).where("embedding is not null")
    made = made.groupBy("description").agg(F.min("embedding").alias("embedding"))
    kind = vectors.schema["embedding"].dataType
    return known.unionByName(made.withColumn("embedding", F.col("embedding").cast(kind)))


def reconcile(
    rows: DataFrame,
    catalog: DataFrame,
    snapshot: DataFrame,
    retention: DataFrame,
    description_vectors: DataFrame,
    column_vectors: DataFrame,
    responses: DataFrame,
    decisions: DataFrame,
    type_decisions: DataFrame,
    run_ts: Column,
    terms: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    **vector_options,
) -> Reconciliation:
    """Parsed rows to report.  ``keep`` (for instance ``session.cut_lineage``) is applied
    to the results that several steps share: distinct questions, placed vectors,
    candidates, searched rows and classified rows.  ``embed``, where given, makes vectors in
    this run for descriptions that have none (see :func:`filled_vectors`)."""
    found = match.exact_match(rows.select(*SPEC), catalog)
    missed = found.where("n_matches = 0").select(*SPEC).withColumn("ask_id", ask_key(rows))
    if embed is not None:
        description_vectors = keep(filled_vectors(missed, description_vectors, embed))
    # a description without text needs no vector; any other waits until it has one
    described = description_vectors.where("embedding is not null").select("description").distinct()
    asks = keep(
        missed.select("ask_id", strip(F.col("eng_name")).alias("eng_name"), "description")
        .distinct()
        .join(described.withColumn("known", F.lit(True)), "description", "left")
        .withColumn("ready", F.coalesce("known", is_blank(F.col("description"))))
        .drop("known")
    )
    waits = asks.where("not ready").select("ask_id", "description")
    ready = missed.join(waits, "ask_id", "left_anti")
    candidates = keep(
        find_candidates(
            asks.where("ready").drop("ready"), catalog, description_vectors, column_vectors, terms, term_vectors,
            string_keep=keep, keep=keep, **vector_options,
        )
    )
    searched = keep(resolve(ready, candidates, responses, decisions))
    resolved = (
        exact_rows(found.where("n_matches > 0"))
        .unionByName(searched_rows(searched, catalog))
        .unionByName(waiting_rows(missed.join(waits, "ask_id", "left_semi")))
    )
    classified = keep(C.classify(check_columns(resolved, snapshot, type_decisions, retention)))
    merged = report.label_map(report.report_rows(classified))
    person = searched.where("route = 'human_confirm'").withColumn("column_id", F.col("target_id"))
    asked_types = classified.where("type_decision is not null")
    return Reconciliation(
        candidates=candidates,
        resolved=classified,
        open_vectors=waits.select("description").distinct(),
        open_judgments=open_judgments(searched, candidates, catalog),
        open_matches=person.where("decision is null").select(
            *SPEC, "attempt", "column_id", "confidence", "evidence", "candidates"
        ),
        open_types=V.type_queue(classified),
        classified=C.tagged(classified),
        rejects=C.rejects(classified),
        report=merged,
        summary=report.summary_stats(merged),
        tag_writes=_match_writes(searched, run_ts).unionByName(C.tag_writes(classified, run_ts)),
        revisions=report.revision_records(
            merged, catalog if "tag" in catalog.columns else None, run_ts
        ),
        auto_confirms=report.auto_confirm_records(classified, run_ts),
        confirmations=report.confirmation_records(
            person, J.match_question(person), "decision", run_ts
        ).unionByName(
            report.confirmation_records(asked_types, V.type_question(asked_types), "type_decision", run_ts)
        ),
        validations=C.validation_log(classified, run_ts),
    )


def _match_writes(searched: DataFrame, at: Column) -> DataFrame:
    """Tags written when a search ends: auto_confirmed, inferred_confirmed or unresolved."""
    ended = searched.where("match_status <> 'pending' and route <> 'no_match' and target_id is not null")
    return ended.select(
        F.col("target_id").alias("column_id"),
        F.col("match_status").alias("tag"),
        "confidence",
        at.alias("updated_at"),
        F.lit(0).alias("stage"),
        *ROW,
    )
