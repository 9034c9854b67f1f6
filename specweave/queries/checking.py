"""Queries that check requests against the real tables, tag and report them."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import catalog as cat
from specweave.operators import classify as C
from specweave.operators import judge, match, report
from specweave.operators import validate as V
from specweave.plans import reconcile as plan
from specweave.queries import matching  # noqa: F401  (its CTEs are used here)
from specweave.queries.inputs import GHOST, MONTH_COLUMNS, OVERRIDES, TABLES, Inputs
from specweave.queries.oracle import PATH_LABEL, TAG_LABEL, compared_cte, cte, parsed_cte, printf, quoted
from specweave.queries.registry import query
from specweave.session import Kept
from specweave.sources import sheets, sinks, tables

RUN_TS = datetime.datetime(2024, 5, 6, 7, 8)


def scratch(i: Inputs, name: str) -> str:
    """A new folder for written results: in the shared folder, or else in the session's warehouse."""
    folder = i.spark.conf.get("spark.checkpoint.dir", None) or i.spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def real_snapshot(i: Inputs) -> DataFrame:
    return tables.catalog_snapshot(i.spark, i.tables(TABLES))


def column_spec(i: Inputs) -> DataFrame:
    """The catalog: the snapshot with its overrides and one column that does not exist."""
    real = real_snapshot(i)
    ghost = tables.small_table(i.spark, [(*GHOST, 0)], M.SNAPSHOT)
    overrides = tables.small_table(
        i.spark, OVERRIDES, "table_id string, column_name string, declared_type string"
    )
    names = real.unionByName(ghost).select(
        "column_name", F.col("column_name").alias("local_name"), F.col("column_name").alias("description")
    )
    return cat.catalog_build(real.unionByName(ghost), names.distinct(), overrides)


def retention(i: Inputs) -> DataFrame:
    return V.retention_period(i.tables(list(MONTH_COLUMNS)), V.months(MONTH_COLUMNS))


def found(i: Inputs) -> DataFrame:
    return plan.exact_rows(match.exact_match(i["requests"], column_spec(i)))


def matched(i: Inputs) -> DataFrame:
    return V.validation_scope(found(i))


def checked(i: Inputs) -> DataFrame:
    return plan.check_columns(matched(i), real_snapshot(i), i["type_decisions"], retention(i))


def classified(i: Inputs) -> DataFrame:
    return C.classify(checked(i))


def reported(i: Inputs) -> DataFrame:
    rows = plan.check_columns(found(i), real_snapshot(i), i["type_decisions"], retention(i))
    return report.report_rows(C.classify(rows))


_KEY = "spec_id, row_idx"


@query(
    "validation_scope",
    f"select {_KEY}, column_id, 'matched' match_status from matched_requests where n_matches > 0",
)
def _(i: Inputs) -> DataFrame:
    return V.validation_scope(found(i)).select("spec_id", "row_idx", "column_id", "match_status")


@query(
    "column_exists",
    f"select {_KEY}, table_id, column_name, col_exists, actual_type from checked_requests",
)
def _(i: Inputs) -> DataFrame:
    return V.column_exists(matched(i), real_snapshot(i)).select(
        "spec_id", "row_idx", "table_id", "column_name", F.col("exists").alias("col_exists"), "actual_type"
    )


@query(
    "type_compare",
    f"""select {_KEY}, spec_type, actual_type,
  case when col_exists then upper(spec_type) = upper(actual_type) end type_equal from checked_requests""",
)
def _(i: Inputs) -> DataFrame:
    rows = V.type_compare(V.column_exists(matched(i), real_snapshot(i)))
    return rows.select("spec_id", "row_idx", "spec_type", "actual_type", "type_equal")


@query(
    "type_confirmation",
    f"""select {_KEY}, type_match_status, case when type_match_status in ('matched', 'mismatch_confirmed')
    then actual_type when type_match_status = 'mismatch_rejected' then spec_type end final_type
from checked_requests""",
)
def _(i: Inputs) -> DataFrame:
    rows = V.type_compare(V.column_exists(matched(i), real_snapshot(i)))
    return V.type_confirmation(rows, i["type_decisions"], plan.ROW).select(
        "spec_id", "row_idx", "type_match_status", "final_type"
    )


@query("retention_period", "select table_id, ret_start, ret_end from retention")
def _(i: Inputs) -> DataFrame:
    return retention(i)


@query("retention_lookup", f"select {_KEY}, table_id, ret_start, ret_end from checked_requests")
def _(i: Inputs) -> DataFrame:
    rows = V.column_exists(matched(i), real_snapshot(i))
    return V.add_retention(rows, retention(i)).select("spec_id", "row_idx", "table_id", "ret_start", "ret_end")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"


@query("row_cap", f"select {_LINE} from lineitem order by l_orderkey, l_linenumber, l_partkey, l_quantity limit {M.ROW_CAP}")
def _(i: Inputs) -> DataFrame:
    columns = _LINE.split(", ")
    return V.row_cap(i["lineitem"].select(*columns), M.ROW_CAP, columns)


cte("parsed_specs", parsed_cte("spec_rows"))


@query("period_parse", f"select {_KEY}, req_period, req_start, req_end, coalesce(bad, false) bad_period from parsed_specs")
def _(i: Inputs) -> DataFrame:
    return C.period_parse(i["spec_rows"]).select(
        "spec_id", "row_idx", "req_period", "req_start", "req_end", "bad_period"
    )


cte(
    "held_specs",
    "select p.*, ret_start, ret_end from (select *, case row_idx % 4 when 0 then 'orders' when 1 then 'lineitem' "
    "when 2 then 'events' else 'customer' end held from parsed_specs) p left join retention t on t.table_id = p.held",
)
cte("compared_specs", compared_cte("held_specs"))


@query(
    "period_compare",
    f"select {_KEY}, period_tag, fs final_start, fe final_end, period_evidence from compared_specs",
)
def _(i: Inputs) -> DataFrame:
    held = F.when(F.col("row_idx") % 4 == 0, "orders").when(F.col("row_idx") % 4 == 1, "lineitem")
    rows = C.period_parse(i["spec_rows"]).withColumn(
        "table_id", held.when(F.col("row_idx") % 4 == 2, "events").otherwise("customer")
    )
    rows = V.add_retention(rows.withColumn("exists", F.lit(True)), retention(i))
    return C.period_compare(rows).select(
        "spec_id", "row_idx", "period_tag", "final_start", "final_end", "period_evidence"
    )


_CLASSIFIED = ["final_tag", "evidence", "final_start", "final_end", "reject_reason"]


@query("classify", f"select {_KEY}, column_id, {', '.join(_CLASSIFIED)} from classified")
def _(i: Inputs) -> DataFrame:
    return classified(i).select("spec_id", "row_idx", "column_id", *_CLASSIFIED)


@query(
    "classify_tags",
    """select c.column_id, w.tag, w.confidence from column_spec c left join (
  select *, row_number() over (partition by column_id order by spec_id desc, row_idx desc) k from (
    select column_id, final_tag tag, 1e0 confidence, spec_id, row_idx from classified where final_tag is not null) x
  ) w on w.column_id = c.column_id and w.k = 1""",
)
def _(i: Inputs) -> DataFrame:
    writes = C.tag_writes(classified(i), F.lit(RUN_TS))
    tagged = judge.tag_upsert(column_spec(i), writes, ["stage", "spec_id", "row_idx"])
    return tagged.select("column_id", "tag", "confidence")


_REPORT = [
    "eng_name", "local_name", "description", "req_period", "req_type", "avail_type", "avail_period",
    "source_table", "final_tag", "evidence", "resolution_path", "asked_type", "column_id",
]


@query("report_rows", f"select {_KEY}, {', '.join(_REPORT)} from reported")
def _(i: Inputs) -> DataFrame:
    return reported(i).select("spec_id", "row_idx", *_REPORT)


@query("report_union", f"select {_KEY}, {', '.join(_REPORT)} from reported")
def _(i: Inputs) -> DataFrame:
    """The same report from two separate inputs."""
    ended = found(i).where("match_status = 'unresolved'")
    return report.report_union(C.tagged(classified(i)), ended).select("spec_id", "row_idx", *_REPORT)


@query("label_map", f"select {_KEY}, final_tag, {TAG_LABEL} tag_label, {PATH_LABEL} path_label from reported")
def _(i: Inputs) -> DataFrame:
    return report.label_map(reported(i)).select("spec_id", "row_idx", "final_tag", "tag_label", "path_label")


@query(
    "period_format",
    f"select {_KEY}, case when fs is not null and fe is not null then concat(fs, '~', fe) end avail_period "
    "from compared_specs",
)
def _(i: Inputs) -> DataFrame:
    held = F.when(F.col("row_idx") % 4 == 0, "orders").when(F.col("row_idx") % 4 == 1, "lineitem")
    rows = C.period_parse(i["spec_rows"]).withColumn(
        "table_id", held.when(F.col("row_idx") % 4 == 2, "events").otherwise("customer")
    )
    rows = C.period_compare(V.add_retention(rows.withColumn("exists", F.lit(True)), retention(i)))
    return report.period_format(rows).select("spec_id", "row_idx", "avail_period")


@query(
    "summary_stats",
    """select 'total' kind, null key, count(*) n from reported
union all select 'tag', final_tag, count(*) from reported group by final_tag
union all select 'path', resolution_path, count(*) from reported group by resolution_path
union all select 'auto_confirm', null, sum(case when resolution_path = 'auto_confirmed' then 1 else 0 end)::bigint
  from reported""",
)
def _(i: Inputs) -> DataFrame:
    return report.summary_stats(reported(i))


@query(
    "run_results",
    f"""select {_KEY}, req_period, source_table, final_tag, evidence, {TAG_LABEL} tag_label from reported""",
)
def _(i: Inputs) -> DataFrame:
    """Two stored runs over all rows that differ in the evidence; one is read back whole."""
    path = scratch(i, "runs")
    with Kept(i.spark) as keep:
        merged = keep(report.label_map(reported(i)))
        sinks.report_sink(merged.withColumn("evidence", F.concat(F.lit("earlier: "), "evidence")), path, "r1")
        sinks.report_sink(merged, path, "r2")
    return report.run_results(i.spark.read.parquet(path), "r2").select(
        "spec_id", "row_idx", "req_period", "source_table", "final_tag", "evidence", "tag_label"
    )


_SUNK = ["eng_name", "avail_period", "source_table", "final_tag", "tag_label", "evidence"]


@query(
    "report_sink",
    f"""select run_id, {_KEY}, eng_name, avail_period, source_table, final_tag, {TAG_LABEL} tag_label, evidence
from reported cross join (select 'r1' run_id union all select 'r2') runs""",
)
def _(i: Inputs) -> DataFrame:
    """Two runs, the first one written twice, read back."""
    path = scratch(i, "report")
    with Kept(i.spark) as keep:
        merged = keep(report.label_map(reported(i)))
        for run_id in ("r1", "r2", "r1"):
            sinks.report_sink(merged, path, run_id)
    return i.spark.read.parquet(path).select("run_id", "spec_id", "row_idx", *_SUNK)


@query(
    "audit_append",
    f"""select run_id, created_date, coalesce(column_id, eng_name) column_id, final_tag after_tag,
  concat('resolution_path=', resolution_path) reason, count(*) n
from reported cross join (select 'r0' run_id, '2024-05-06' created_date union all select 'r1', '2024-05-07') days
group by all""",
)
def _(i: Inputs) -> DataFrame:
    """Two runs on two days, the first one repeated, read back."""
    path = scratch(i, "revisions")
    merged = reported(i)
    for day in (0, 1, 0):
        at = F.lit(RUN_TS + datetime.timedelta(days=day))
        sinks.audit_append(report.revision_records(merged, None, at), path, f"r{day}")
    back = i.spark.read.parquet(path).withColumn("created_date", F.col("created_date").cast("string"))
    return back.groupBy("run_id", "created_date", "column_id", "after_tag", "reason").agg(F.count("*").alias("n"))


@query(
    "revision_records",
    """select coalesce(r.column_id, eng_name) column_id, 'old' before_tag, final_tag after_tag,
  concat('resolution_path=', resolution_path) reason, count(*) n from reported r
  where r.column_id is not null group by all
union all select eng_name, null, final_tag, concat('resolution_path=', resolution_path), count(*) from reported r
  where r.column_id is null group by all""",
)
def _(i: Inputs) -> DataFrame:
    previous = column_spec(i).select("column_id", F.lit("old").alias("tag"))
    lines = report.revision_records(reported(i), previous, F.lit(RUN_TS))
    return lines.groupBy("column_id", "before_tag", "after_tag", "reason").agg(F.count("*").alias("n"))


@query(
    "validation_log",
    """select column_id, spec_type, actual_type, type_match_status = 'matched' is_match, final_tag, count(*) n
from classified group by all""",
)
def _(i: Inputs) -> DataFrame:
    log = C.validation_log(classified(i), F.lit(RUN_TS))
    return log.groupBy("column_id", "spec_type", "actual_type", "is_match", "final_tag").agg(
        F.count("*").alias("n")
    )


@query(
    "type_question",
    f"""select {_KEY}, {printf(M.ASK_TYPE, 'column_id', 'spec_type', 'actual_type')} question
from checked_requests where type_match_status = 'pending'""",
)
def _(i: Inputs) -> DataFrame:
    waiting = V.type_queue(checked(i))
    return waiting.select("spec_id", "row_idx", V.type_question(waiting).alias("question"))


@query(
    "output_naming",
    r"""select page_id, concat(regexp_replace(url, '([^/])\.[^./]*$', '\1'), '(output)_20240506_0708') output_path
from pages""",
)
def _(i: Inputs) -> DataFrame:
    return sinks.output_names(i["pages"], "url", F.lit(RUN_TS)).select("page_id", "output_path")


@query(
    "csv_dict_scan",
    "select c_name, cast(c_custkey as varchar) c_custkey, c_mktsegment || ', \"x\"' || chr(10) || 'y' note from customer",
)
def _(i: Inputs) -> DataFrame:
    """Customers written as header CSV with a byte-order mark, quotes and line breaks, read back."""
    path = scratch(i, "eval")
    note = F.concat("c_mktsegment", F.lit(', "x"\ny'))
    rows = i["customer"].select("c_name", "c_custkey", note.alias("note"))
    rows.toDF("﻿c_name", "c_custkey", "note").write.csv(path, header=True, escape='"')
    return sheets.read_csv_with_header(i.spark, path)


@query(
    "metrics_sink",
    """select cast(count(*) as varchar) n,
  cast(round(avg(case when n_matches > 0 then 1e0 else 0 end), 4) as varchar) exact_hit_rate from matched_specs""",
)
def _(i: Inputs) -> DataFrame:
    metrics = match.exact_match(i["spec_rows"], i["meta_columns"]).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("n_matches") > 0, 1.0).otherwise(0.0)), 4).alias("exact_hit_rate"),
    )
    return sheets.read_csv_with_header(i.spark, sinks.metrics_sink(metrics, scratch(i, "metrics")))
