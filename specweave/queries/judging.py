"""Queries over judgments, routing and confirmations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import evaluate, judge
from specweave.plans import reconcile as plan
from specweave.queries.checking import scratch
from specweave.queries.inputs import Inputs
from specweave.queries.matching import ask_candidates
from specweave.queries.oracle import case_of, cte, quoted
from specweave.queries.registry import query
from specweave.sources import buckets, catalogs


def parsed_sql(replies: str) -> str:
    ok = (
        "coalesce(json_valid(body) and json_type(try_cast(body as json)) = 'OBJECT' and "
        "(raw is null or try_cast(raw as double) is not null), false)"
    )
    return f"""select *, case when ok then sel end selected_column_id,
  case when ok then greatest(0e0, least(1e0, coalesce(try_cast(raw as double), 0e0))) else 0e0 end confidence,
  case when ok then coalesce(ev, '') else {quoted(M.EV_BAD_RESPONSE)} end evidence,
  coalesce(case when ok then act end, 'human_confirm') recommend_action
from (select *, {ok} ok from (select *,
    case when json_valid(body) then json_extract_string(body, '$.selected_column_id') end sel,
    case when json_valid(body) then json_extract_string(body, '$.confidence') end raw,
    case when json_valid(body) then json_extract_string(body, '$.evidence') end ev,
    case when json_valid(body) then json_extract_string(body, '$.recommend_action') end act
  from (select *, case when starts_with(trim(response), '```')
      then regexp_replace(trim(trim(response), '`'), '^[^\\n]*\\n', '') else trim(response) end body
    from {replies}) b) c) d"""


def guarded_sql(parsed: str, listed: str) -> str:
    """``listed`` is true where the selection is a candidate."""
    return f"""select * exclude (selected_column_id, confidence, evidence, recommend_action),
  outside hallucination_flag, case when not outside then selected_column_id end selected_column_id,
  case when outside then 0e0 else confidence end confidence,
  case when outside then trim(concat(evidence, {quoted(M.EV_OUTSIDE_SUFFIX)})) else evidence end evidence,
  case when outside then 'human_confirm' else recommend_action end recommend_action
from (select *, selected_column_id is not null and not coalesce({listed}, false) outside from {parsed}) g"""


def route_sql(confidence: str, attempt: str, selected: str | None = None, at="0.92", low="0.70") -> str:
    sure = f"{confidence} >= {at}"
    first = f"when {sure} then 'auto_confirm'" if selected is None else (
        f"when {sure} and {selected} is not null then 'auto_confirm' when {sure} then 'human_confirm'"
    )
    return (
        f"case {first} when {confidence} < {low} then 'human_confirm' "
        f"when {attempt} < {M.MAX_RETRIES} then 'retry' else 'human_confirm' end"
    )


cte("parsed_replies", parsed_sql("responses"))
cte("guarded_replies", guarded_sql("parsed_replies", "list_contains(['c1', 'c2', 'c3'], selected_column_id)"))
cte(
    "routed_replies",
    f"select *, {route_sql('confidence', 'attempt', 'selected_column_id')} route from guarded_replies",
)
_JUDGED = ["selected_column_id", "confidence", "evidence", "recommend_action"]


def _guarded(i: Inputs) -> DataFrame:
    parsed = judge.judge_parse(i["responses"])
    return judge.judge_guard(parsed.withColumn("candidate_ids", F.array(F.lit("c1"), F.lit("c2"), F.lit("c3"))))


def _routed(i: Inputs) -> DataFrame:
    step = judge.route(F.col("confidence"), F.col("attempt"), F.col("selected_column_id"))
    return _guarded(i).withColumn("route", step)


@query(
    "judge_request",
    """select a.spec_id, a.row_idx, attempt, eng_name, home_id local_name, a.description, listed from vec_asks a join (
  select ask_id, attempt, string_agg(concat_ws('/', rank, c.column_id, column_name, table_id, v.description, source,
    cast(round(score * 10000) as bigint)), ';' order by rank) listed
  from ask_candidates c join vec_columns v on v.column_id = c.column_id group by ask_id, attempt) l on l.ask_id = a.ask_id""",
)
def _(i: Inputs) -> DataFrame:
    """The payloads, read back field by field."""
    waiting = i["vec_asks"].withColumn("local_name", F.col("home_id")).withColumn("route", F.lit("awaiting_judgment"))
    candidates = ask_candidates(i)
    waiting = waiting.join(candidates.select("ask_id", "attempt").distinct(), "ask_id")
    waiting = waiting.withColumn("candidates", F.lit(None).cast("string"))
    sent = plan.open_judgments(waiting, candidates, i["vec_columns"])
    item = "rank: int, column_id: string, column_name: string, table_id: string, description: string, source: string, score: double"
    source = "eng_name: string, local_name: string, description: string"
    read = F.from_json("payload", f"struct<source_column: struct<{source}>, candidates: array<struct<{item}>>>")

    def line(c):
        score = F.round(c["score"] * 10000).cast("long")
        parts = [c[f] for f in ("rank", "column_id", "column_name", "table_id", "description", "source")]
        return F.concat_ws("/", *parts, score)

    return sent.withColumn("read", read).select(
        "spec_id", "row_idx", "attempt", "read.source_column.*",
        F.array_join(F.transform("read.candidates", line), ";").alias("listed"),
    )


@query("judge_parse", f"select req_id, {', '.join(_JUDGED)} from parsed_replies")
def _(i: Inputs) -> DataFrame:
    return judge.judge_parse(i["responses"]).select("req_id", *_JUDGED)


@query("judge_guard", f"select req_id, hallucination_flag, {', '.join(_JUDGED)} from guarded_replies")
def _(i: Inputs) -> DataFrame:
    return _guarded(i).select("req_id", "hallucination_flag", *_JUDGED)


@query("route", "select req_id, attempt, route from routed_replies")
def _(i: Inputs) -> DataFrame:
    return _routed(i).select("req_id", "attempt", "route")


@query(
    "retry_params",
    "select req_id, attempt, cast(5 + 3 * attempt as int) top_k, "
    "round(greatest(0.55e0, 0.75e0 - 0.10e0 * attempt), 4) floor, attempt > 0 glossary_boost from responses",
)
def _(i: Inputs) -> DataFrame:
    rows = judge.retry_params(i["responses"].select("req_id", "attempt"))
    return rows


def tried_sql(asks: str, candidates: str, replies: str) -> str:
    """Every attempt of every ask with its candidate list and its reply."""
    return f"""select a.spec_id, a.row_idx, a.ask_id, t.attempt, c.ids, r.response from {asks} a cross join attempts t
left join (select ask_id, attempt, list(column_id order by rank) ids from {candidates} group by all) c
  on c.ask_id = a.ask_id and c.attempt = t.attempt
left join {replies} r on r.spec_id = a.spec_id and r.row_idx = a.row_idx and r.attempt = t.attempt"""


def left_sql(tried: str) -> str:
    """The first attempt that does not ask for a retry."""
    judged = guarded_sql("(" + parsed_sql(tried) + ") p", "list_contains(ids, selected_column_id)")
    return f"""select * from (select *, row_number() over (partition by spec_id, row_idx order by attempt) first_exit from (
  select *, case when ids is null then 'no_match' when response is null then 'awaiting_judgment'
    else {route_sql('confidence', 'attempt', 'selected_column_id')} end route
  from ({judged}) g) r where route <> 'retry') e where first_exit = 1"""


cte("tried_asks", tried_sql("vec_asks", "ask_candidates", "vec_replies"))
cte("left_asks", left_sql("tried_asks"))


@query(
    "retry_widening",
    "select spec_id, row_idx, attempt, route, selected_column_id, confidence, evidence, "
    "coalesce(len(ids), 0) n_candidates, coalesce(selected_column_id, ids[1]) target_id from left_asks",
)
def _(i: Inputs) -> DataFrame:
    left = judge.retry_widening(i["vec_asks"], ask_candidates(i), i["vec_replies"])
    return left.select(
        "spec_id", "row_idx", "attempt", "route", "selected_column_id", "confidence", "evidence",
        F.coalesce(F.array_size("candidates"), F.lit(0)).cast("long").alias("n_candidates"),
        judge.target_of(left).alias("target_id"),
    )


@query(
    "no_candidate",
    f"""select spec_id, row_idx, 'unresolved' match_status, {quoted(M.EV_NO_CANDIDATE)} match_evidence,
  'no_match' resolution_path from vec_asks where ask_id not in (select ask_id from ask_candidates where attempt = 0)""",
)
def _(i: Inputs) -> DataFrame:
    asks = i["vec_asks"].select("spec_id", "row_idx", "ask_id")
    rows = judge.no_candidate(asks, ask_candidates(i).where("attempt = 0"), ["ask_id"])
    return rows.select("spec_id", "row_idx", "match_status", "match_evidence", "resolution_path")


@query(
    "confirmation_queue",
    "select req_id, evidence, confidence from routed_replies where route = 'human_confirm' "
    "and req_id not in (select req_id from decisions)",
)
def _(i: Inputs) -> DataFrame:
    waiting = _routed(i).where("route = 'human_confirm'")
    return judge.confirmation_queue(waiting, i["decisions"], ["req_id"]).select(
        "req_id", "evidence", "confidence"
    )


@query(
    "apply_confirmation",
    """select r.req_id, decision, case when decision is null then 'pending' when decision = 'approved'
    then 'inferred_confirmed' else 'unresolved' end match_status,
  case when decision is null then 'pending' when decision = 'approved' then 'approved' else 'rejected' end
    confirmation_status
from routed_replies r left join decisions d on d.req_id = r.req_id where route = 'human_confirm'""",
)
def _(i: Inputs) -> DataFrame:
    waiting = _routed(i).where("route = 'human_confirm'")
    return judge.apply_confirmation(waiting, i["decisions"], ["req_id"]).select(
        "req_id", "decision", "match_status", "confirmation_status"
    )


_TAGGED = """select *, case when length(column_id) % 2 = 0 then 'old' end tag,
  case when length(column_id) % 2 = 0 then 0.5e0 end confidence, cast(null as timestamp) updated_at from meta_columns"""
_WRITES = """select m.column_id, case when row_idx % 4 = 0 then 'full_period' when row_idx % 4 = 1 then 'not_found'
    else 'type_mismatch' end tag, row_idx % 10 / 10e0 confidence, cast(null as timestamp) updated_at,
  cast(row_idx % 2 as int) stage, spec_id, row_idx
from spec_rows s join meta_columns m on m.column_name = trim(s.eng_name)"""


@query(
    "tag_upsert",
    f"""select c.column_id, coalesce(w.tag, c.tag) tag, coalesce(w.confidence, c.confidence) confidence
from ({_TAGGED}) c left join (select * from (select *,
  row_number() over (partition by column_id order by stage desc, spec_id desc, row_idx desc) k
  from ({_WRITES}) x) y where k = 1) w on w.column_id = c.column_id""",
)
def _(i: Inputs) -> DataFrame:
    catalog = i.sql(_TAGGED, "meta_columns")
    writes = i.sql(_WRITES, "spec_rows", "meta_columns")
    return judge.tag_upsert(catalog, writes, ["stage", "spec_id", "row_idx"]).select(
        "column_id", "tag", "confidence"
    )


@query(
    "tag_upsert_stored",
    f"""select c.column_id, coalesce(w.tag, c.tag) tag, coalesce(w.confidence, c.confidence) confidence
from ({_TAGGED}) c left join (select * from (select *,
  row_number() over (partition by column_id order by stage desc, spec_id desc, row_idx desc) k
  from ({_WRITES}) x) y where k = 1) w on w.column_id = c.column_id""",
)
def _(i: Inputs) -> DataFrame:
    """A stored catalog changed in place, stage by stage; the last stage is repeated."""
    path, order = scratch(i, "tags"), ["stage", "spec_id", "row_idx"]
    catalog = i.sql(_TAGGED, "meta_columns")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in catalog.schema)
    buckets.write_buckets(catalog, path, catalogs.COLUMN)
    writes = i.sql(_WRITES, "spec_rows", "meta_columns")
    for stage in (0, 1, 1):
        catalogs.store_tags(writes.where(F.col("stage") == stage), path, schema, order)
    return buckets.read_buckets(i.spark, path, schema).select("column_id", "tag", "confidence")


@query(
    "matching_summary",
    "select case when n_matches > 0 then 'matched' else 'unresolved' end match_status, count(*) n "
    "from matched_specs group by 1",
)
def _(i: Inputs) -> DataFrame:
    from specweave.operators.match import exact_match

    found = exact_match(i["spec_rows"], i["meta_columns"])
    status = F.when(F.col("n_matches") > 0, "matched").otherwise("unresolved")
    return judge.matching_summary(found.withColumn("match_status", status))


def _counts_sql(step: str) -> str:
    return ", ".join(
        f"sum(case when {step} = '{r}' then 1 else 0 end)::bigint {quoted(n)[1:-1]}"
        for r, n in evaluate.ROUTES.items()
    )


@query(
    "eval_routes",
    f"""select spec_id, count(*) evaluated, {_counts_sql('step')},
  sum(case when step = 'no_candidates' then 1 else 0 end)::bigint no_candidates
from (select spec_id, case when ids is null then 'no_candidates' else {route_sql('confidence', '0')} end step
  from ({guarded_sql('(' + parsed_sql('tried_asks') + ') p', 'list_contains(ids, selected_column_id)')}) g
  where attempt = 0) s group by spec_id""",
)
def _(i: Inputs) -> DataFrame:
    first = ask_candidates(i).where("attempt = 0")
    listed = first.groupBy("ask_id").agg(F.collect_list("column_id").alias("candidate_ids"))
    replies = i["vec_replies"].where("attempt = 0").drop("attempt")
    tried = i["vec_asks"].join(listed, "ask_id", "left").join(replies, ["spec_id", "row_idx"], "left")
    judged = judge.judge_guard(judge.judge_parse(tried))
    return evaluate.eval_routes(
        judged.withColumn("has_candidate", F.col("candidate_ids").isNotNull()), ["spec_id"]
    )


_SETTINGS = [(0.85, 0.6), (0.92, 0.7), (0.95, 0.8)]


@query(
    "threshold_sweep",
    "\nunion all ".join(
        f"select {a}e0 auto_at, {r}e0 retry_from, count(*) evaluated, "
        + _counts_sql(route_sql("confidence", "attempt", None, str(a), str(r)))
        + " from guarded_replies"
        for a, r in _SETTINGS
    ),
)
def _(i: Inputs) -> DataFrame:
    return evaluate.threshold_sweep(_guarded(i), _SETTINGS)


def resolved_sql(left: str, decisions: str) -> str:
    ended = case_of("route", {"auto_confirm": "auto_confirmed", "no_match": "unresolved", "awaiting_judgment": "pending"})
    return f"""select spec_id, row_idx, route, attempt, coalesce(selected_column_id, ids[1]) target_id, match_status,
  case when route = 'no_match' then {quoted(M.EV_NO_CANDIDATE)}
    when route = 'human_confirm' and match_status = 'unresolved' then {quoted(M.EV_REJECTED)}
    when match_status in ('auto_confirmed', 'inferred_confirmed') then evidence end match_evidence,
  case when route = 'auto_confirm' then 'auto_confirmed' when route = 'no_match' then 'no_match'
    when match_status = 'unresolved' then 'rejected_by_human' when match_status = 'inferred_confirmed' then 'validated'
    end resolution_path
from (select l.*, coalesce({ended}, case when d.decision is null then 'pending' when d.decision = 'approved'
    then 'inferred_confirmed' else 'unresolved' end) match_status
  from {left} l left join {decisions} d on d.spec_id = l.spec_id and d.row_idx = l.row_idx) x"""


_RESOLVED = resolved_sql("left_asks", "vec_decisions")


@query("resolve", _RESOLVED)
def _(i: Inputs) -> DataFrame:
    done = plan.resolve(i["vec_asks"], ask_candidates(i), i["vec_replies"], i["vec_decisions"])
    return done.select(
        "spec_id", "row_idx", "route", "attempt", "target_id", "match_status", "match_evidence", "resolution_path"
    )
