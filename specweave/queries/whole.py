"""A whole reconciliation run: rows to report, with retrieval, judgment and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import strip
from specweave.operators import catalog as cat
from specweave.operators.match import widest
from specweave.plans.reconcile import Reconciliation, reconcile
from specweave.plans.sheets import SheetsRun, read_sheets, sheets_to_report, store_run, unkeyed
from specweave.queries.checking import RUN_TS, column_spec, real_snapshot, retention, scratch
from specweave.queries.inputs import Inputs
from specweave.queries.judging import left_sql, resolved_sql, tried_sql
from specweave.queries.matching import fuzzy_sql, merged_sql, nearest_sql
from specweave.queries.oracle import (
    PATH_LABEL, TAG_LABEL, checked_cte, classified_cte, compared_cte, cte, exact_cte, parsed_cte, quoted,
)
from specweave.queries.registry import query
from specweave.session import Kept, shared

_WIDE = widest()
_LIMIT, _FLOOR = _WIDE["vector_limit"], _WIDE["floor"]

cte("plan_matched", exact_cte("plan_rows", "column_spec"))
cte(
    "plan_missed",
    "select spec_id, row_idx, trim(eng_name) eng_name, description, concat(trim(eng_name), '/', description) ask_id "
    "from plan_matched where n_matches = 0",
)
cte("plan_asks", "select distinct ask_id, eng_name, description from plan_missed")
# A column's vector is chosen by the length of its id, so some columns share one vector.
cte(
    "plan_column_vectors",
    "select column_id entry_id, embedding e from column_spec join embeddings on vec_id = length(column_id)",
)
cte(
    "plan_term_vectors",
    "select concat('g', column_id) entry_id, column_id, embedding e from column_spec "
    "join embeddings on vec_id = length(column_id) + 1",
)
_QUERIES = """(select description query_id, embedding q from plan_vectors
  where description in (select description from plan_asks)) qs"""
cte(
    "plan_hits",
    f"""select ask_id, entry_id column_id, 'vss_column' source, 1 source_no, similarity score, vector_rank place
from ({nearest_sql(_QUERIES, 'plan_column_vectors', _LIMIT, _FLOOR)}) a join plan_asks on description = query_id
union all
select ask_id, t.column_id, 'vss_glossary', 2, similarity, vector_rank
from ({nearest_sql(_QUERIES, 'plan_term_vectors', _LIMIT, _FLOOR)}) b join plan_asks on description = query_id
join plan_term_vectors t on t.entry_id = b.entry_id
union all
select ask_id, column_id, 'fuzzy', 3, score, string_rank
from ({fuzzy_sql('plan_asks', 'column_spec', _WIDE['top_k'], _WIDE['string_cut'])}) f
join plan_asks p on p.eng_name = f.eng_name""",
)
cte("plan_candidates", merged_sql("plan_hits"))
cte("plan_tried", tried_sql("plan_missed", "plan_candidates", "plan_replies"))
cte("plan_left", left_sql("plan_tried"))
cte("plan_resolved", resolved_sql("plan_left", "plan_decisions"))
cte(
    "plan_results",
    f"""select spec_id, row_idx, req_period, req_type, column_id, table_id, column_name, data_type, 'matched' match_status,
  {quoted(M.EV_EXACT)} match_evidence, 'validated' resolution_path from plan_matched where n_matches > 0
union all
select r.spec_id, r.row_idx, p.req_period, p.req_type, c.column_id, c.table_id, c.column_name, c.data_type,
  r.match_status, r.match_evidence, r.resolution_path
from plan_resolved r join plan_rows p on p.spec_id = r.spec_id and p.row_idx = r.row_idx
left join column_spec c on c.column_id = r.target_id and r.match_status in ('auto_confirmed', 'inferred_confirmed')""",
)
cte(
    "plan_checked",
    checked_cte(
        "(select * from plan_results where match_status in ('matched', 'auto_confirmed', 'inferred_confirmed'))",
        "type_decisions",
    ),
)
cte("plan_parsed", parsed_cte("plan_checked"))
cte("plan_compared", compared_cte("plan_parsed"))
cte("plan_classified", classified_cte("plan_compared"))
cte(
    "plan_reported",
    f"""select spec_id, row_idx, req_period, spec_type req_type, actual_type avail_type,
  case when final_start is not null and final_end is not null then concat(final_start, '~', final_end) end avail_period,
  table_id source_table, final_tag, column_id, case when resolution_path = 'auto_confirmed'
    then concat({quoted(M.EV_AUTO_PREFIX)}, match_evidence, ' | ', evidence) else evidence end evidence,
  case when resolution_path = 'auto_confirmed' then resolution_path else 'validated' end resolution_path
from plan_classified where final_tag is not null
union all
select spec_id, row_idx, req_period, req_type, null, null, null, 'unresolved', null, match_evidence, resolution_path
from plan_results where match_status = 'unresolved'""",
)

_COLUMNS = [
    "spec_id", "row_idx", "req_period", "req_type", "avail_type", "avail_period", "source_table", "final_tag",
    "column_id", "evidence", "resolution_path",
]


def _world(i: Inputs) -> dict:
    """What a run needs beside its rows, replies and decisions."""
    catalog = column_spec(i)
    stored = i["embeddings"].select("vec_id", "embedding")

    def vectors(name: str, shift: int) -> DataFrame:
        return catalog.select(name, (F.length("column_id") + shift).cast("long").alias("vec_id")).join(
            stored, "vec_id"
        ).select(name, "embedding")

    catalog = catalog.withColumn("term_id", F.concat(F.lit("g"), "column_id"))
    terms = catalog.select("term_id", F.col("column_id").alias("linked_column_id"))
    return dict(
        catalog=catalog,
        snapshot=real_snapshot(i),
        retention=retention(i),
        description_vectors=i["plan_vectors"],
        column_vectors=vectors("column_id", 0),
        run_ts=F.lit(RUN_TS),
        terms=terms,
        term_vectors=vectors("term_id", 1),
    )


def run(i: Inputs) -> Reconciliation:
    return reconcile(
        rows=i["plan_rows"],
        responses=i["plan_replies"],
        decisions=i["plan_decisions"],
        type_decisions=i["type_decisions"],
        keep=shared,
        **_world(i),
    )


@query(
    "reconcile",
    f"select {', '.join(_COLUMNS)}, {TAG_LABEL} tag_label, {PATH_LABEL} path_label from plan_reported",
)
def _(i: Inputs) -> DataFrame:
    return run(i).report.select(*_COLUMNS, "tag_label", "path_label")


@query(
    "reconcile_open",
    """select 'judgment' kind, spec_id, row_idx from plan_resolved where route = 'awaiting_judgment'
union all select 'match', spec_id, row_idx from plan_resolved where route = 'human_confirm' and match_status = 'pending'
union all select 'type', spec_id, row_idx from plan_checked where type_match_status = 'pending'
union all select 'reject', spec_id, row_idx from plan_classified where reject_reason is not null""",
)
def _(i: Inputs) -> DataFrame:
    """Everything a run leaves open."""
    done = run(i)

    def lines(kind: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "spec_id", "row_idx")

    return (
        lines("judgment", done.open_judgments)
        .unionByName(lines("match", done.open_matches))
        .unionByName(lines("type", done.open_types))
        .unionByName(lines("reject", done.rejects))
    )


_RUN_ID = "concat('r', cast(cast(spec_id as int) % 3 as varchar))"
_STAR = "orders"


def runs_over_sheets(i: Inputs, keep: Kept) -> SheetsRun:
    def by_run(name: str) -> DataFrame:
        run_id = F.concat(F.lit("r"), (F.col("spec_id").cast("int") % 3).cast("string"))
        return i[name].withColumns({"run_id": run_id, "row_idx": F.col("row_idx") + 3})

    tables = real_snapshot(i).select("table_id").distinct()
    return sheets_to_report(
        i["sheet_cells"],
        relationships=cat.relationship_build(tables, _STAR, "key"),
        responses=by_run("plan_replies"),
        decisions=by_run("plan_decisions"),
        type_decisions=by_run("type_decisions"),
        keep=keep,
        **_world(i),
    )


def _stored_sheets(i: Inputs) -> str:
    """Runs over sheets, stored; shared results are freed before it returns."""
    with Kept(i.spark) as keep:
        return store_run(runs_over_sheets(i, keep), scratch(i, "sheets"))


@query(
    "sheets_to_report",
    f"""select {_RUN_ID.replace('spec_id', 'p.spec_id')} run_id, p.spec_id, p.row_idx + 3 row_idx, trim(p.eng_name) eng_name, r.req_period, r.avail_type, r.avail_period,
  r.source_table, r.final_tag, r.evidence, r.resolution_path, coalesce(n, 0) n_candidate_tables,
  case when r.source_table is null then 0 when r.source_table = '{_STAR}' then (select count(distinct table_id) - 1 from snapshot)
    else 1 end n_relationships
from plan_reported r join plan_rows p on p.spec_id = r.spec_id and p.row_idx = r.row_idx
left join (select column_name, count(*) n from snapshot group by 1) s on s.column_name = trim(p.eng_name)
where cast(p.spec_id as int) % 5 < 3 and p.row_idx % 29 <> 0""",
)
def _(i: Inputs) -> DataFrame:
    """From cells to the stored report of three runs, read back."""
    back = i.spark.read.parquet(f"{_stored_sheets(i)}/report")
    return back.select(
        "run_id", "spec_id", "row_idx", strip(F.col("eng_name")).alias("eng_name"), "req_period", "avail_type", "avail_period",
        "source_table", "final_tag", "evidence", "resolution_path", "n_candidate_tables", "n_relationships",
    )


@query(
    "sheets_relations",
    f"""select r.table_id, '{_STAR}' from_table_id, t.table_id to_table_id, 'key' join_key, '1:N' relation_type
from (select distinct r.source_table table_id from plan_reported r where cast(r.spec_id as int) % 5 < 3 and r.row_idx % 29 <> 0) r
join (select distinct table_id from snapshot where table_id <> '{_STAR}') t on r.table_id in ('{_STAR}', t.table_id)""",
)
def _(i: Inputs) -> DataFrame:
    """Relations of the tables that the stored reports name."""
    back = i.spark.read.parquet(f"{_stored_sheets(i)}/relations")
    return back.select("table_id", "from_table_id", "to_table_id", "join_key", "relation_type")


@query(
    "sheets_read",
    f"""select {_RUN_ID} run_id, spec_id, case cast(spec_id as int) % 5 when 3 then 'missing_field' when 4 then 'no_header' else 'ok' end status,
  case when cast(spec_id as int) % 5 < 3 then count(*) + 2 - cast(spec_id as int) % 5 else 0 end total,
  case when cast(spec_id as int) % 5 < 3 then count(*) filter (row_idx % 29 <> 0) else 0 end parsed
from plan_rows group by spec_id""",
)
def _(i: Inputs) -> DataFrame:
    """Status and row counts of every sheet; notes below a header count as rows."""
    found = unkeyed(read_sheets(i["sheet_cells"]).sheets)
    return found.select("run_id", "spec_id", "status", "total", "parsed")
