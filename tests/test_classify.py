import datetime

import pytest
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import classify as C
from specweave.operators import report
from specweave.operators import validate as V

IN = (
    "spec_id string, row_idx long, column_id string, exists boolean, type_match_status string, actual_type string, "
    "req_period string, ret_start int, ret_end int"
)


@pytest.mark.parametrize(
    "period,start,end,tag,lo,hi,evidence",
    [
        ("202401~202402", None, None, "period_mismatch", None, None, M.EV_NO_RETENTION),
        (None, 202401, 202405, "full_period", 202401, 202405, M.EV_NO_REQUEST % (202401, 202405)),
        ("", 202401, 202405, "full_period", 202401, 202405, M.EV_NO_REQUEST % (202401, 202405)),
        ("202401", 202401, 202405, "full_period", 202401, 202405, M.EV_NO_REQUEST % (202401, 202405)),
        ("1~2~3", 202401, 202405, "full_period", 202401, 202405, M.EV_NO_REQUEST % (202401, 202405)),
        ("202301~202312", 202401, 202405, "period_mismatch", None, None,
         M.EV_DISJOINT % (202301, 202312, 202401, 202405)),
        ("202401 ~ 202405", 202401, 202405, "full_period", 202401, 202405, M.EV_CONTAINED % (202401, 202405)),
        ("202312~202402", 202401, 202405, "confirm_period", 202401, 202402, M.EV_PARTIAL % (202401, 202402)),
        ("202405~202405", 202401, 202405, "full_period", 202405, 202405, M.EV_CONTAINED % (202401, 202405)),
    ],
)
def test_periods(spark, period, start, end, tag, lo, hi, evidence):
    df = spark.createDataFrame([("s", 1, "c", True, "matched", "INTEGER", period, start, end)], IN)
    r = C.classify(df).first()
    assert (r.final_tag, r.final_start, r.final_end, r.evidence, r.reject_reason) == (tag, lo, hi, evidence, None)


def test_order_of_checks(spark):
    rows = [
        ("s", 1, "c", False, None, None, "x~y", 1, 2),
        ("s", 2, "c", True, "mismatch_rejected", "INTEGER", "x~y", 1, 2),
        ("s", 3, "c", True, "mismatch_confirmed", "DOUBLE", "1~2", 1, 2),
        ("s", 4, "c", True, "pending", "DOUBLE", "1~2", 1, 2),
        ("s", 5, "c", True, "matched", "DOUBLE", "x~2", 1, 2),
        ("s", 6, None, None, None, None, "x~2", None, None),
    ]
    got = C.classify(spark.createDataFrame(rows, IN)).orderBy("row_idx").collect()
    assert [r.final_tag for r in got] == ["not_found", "type_mismatch", "full_period", None, None, None]
    assert got[0].evidence == M.EV_NOT_FOUND and got[1].evidence == M.EV_TYPE_MISMATCH
    assert got[2].evidence == M.EV_TYPE_CONFIRMED % "DOUBLE" + M.EV_CONTAINED % (1, 2)
    assert [r.reject_reason for r in got] == [None] * 4 + ["bad_period", None]


def test_types(spark, rows):
    df = spark.createDataFrame(
        [("s", 1, "INTEGER", "integer", True), ("s", 2, "INTEGER", "DOUBLE", True), ("s", 3, "INTEGER", "DOUBLE", True),
         ("s", 4, "INTEGER", "DOUBLE", True), ("s", 5, "INTEGER", None, False)],
        "spec_id string, row_idx long, spec_type string, actual_type string, exists boolean",
    )
    answers = spark.createDataFrame(
        [("s", 2, "approved"), ("s", 3, "rejected"), ("s", 1, "rejected")],
        "spec_id string, row_idx long, decision string",
    )
    done = V.type_confirmation(V.type_compare(df), answers, ["spec_id", "row_idx"])
    assert rows(done.select("row_idx", "type_match_status", "final_type", "type_decision")) == [
        (1, "matched", "integer", None), (2, "mismatch_confirmed", "DOUBLE", "approved"),
        (3, "mismatch_rejected", "INTEGER", "rejected"), (4, "pending", None, None), (5, None, None, None),
    ]


def test_retention(spark, rows):
    facts = spark.createDataFrame([(202403, 1), (202401, 2)], "month int, x int")
    dated = spark.sql("select timestamp'2024-05-31 23:59:59' ts union all select timestamp'2023-12-01 00:00:00'")
    tables = {"f": facts, "d": dated, "n": facts.drop("month")}
    months = {**V.months({"f": "month"}, lambda c: c), **V.months({"d": "ts"})}
    assert rows(V.retention_period(tables, months)) == [("d", 202312, 202405), ("f", 202401, 202403)]
    assert rows(V.retention_period(tables, months, only=["n"])) == []


def test_report_forms_agree_and_labels(spark, rows):
    schema = (
        "spec_id string, row_idx long, eng_name string, local_name string, description string, req_type string, "
        "req_period string, column_id string, table_id string, spec_type string, actual_type string, "
        "match_status string, match_evidence string, resolution_path string, unresolved_reason string, "
        "llm_evidence string, final_tag string, evidence string, final_start int, final_end int"
    )
    data = [
        ("s", 1, "a", "k", "d", "T", " ", "c1", "t", "INTEGER", "INTEGER", "auto_confirmed", "j", "auto_confirmed", None,
         "near", "full_period", "ev", 1, 2),
        ("s", 2, "b", "k", "d", "T", "1~2", "c2", "t", "INTEGER", "DOUBLE", "matched", "m", "validated", None, None,
         "full_period", "ev", 1, 2),
        ("s", 3, "c", "k", "d", "T", None, None, None, None, None, "unresolved", "no", "rejected_by_human",
         "rejected_by_human", None, None, None, None, None),
        ("s", 4, "d", "k", "d", "T", None, None, None, None, None, "pending", None, None, None, None, None, None, None,
         None),
    ]
    df = spark.createDataFrame(data, schema)
    one = report.report_rows(df)
    two = report.report_union(df.where("final_tag is not null"), df.where("match_status = 'unresolved'"))
    assert rows(one.select(two.columns)) == rows(two) and one.count() == 3
    shown = {r.row_idx: r for r in report.label_map(one).collect()}
    assert shown[1].evidence == f"{M.EV_AUTO_PREFIX}near | ev" and shown[1].avail_period == "1~2"
    assert shown[1].tag_label == M.FULL_PERIOD_NO_REQUEST_LABEL
    assert shown[2].tag_label == M.TAG_LABELS["full_period"] and shown[2].req_type == "INTEGER"
    assert shown[3].path_label == M.PATH_LABELS["rejected_by_human"] and shown[3].req_type == "T"
    stats = {(r.kind, r.key): r.n for r in report.summary_stats(one).collect()}
    assert stats[("total", None)] == 3 and stats[("tag", "full_period")] == 2
    assert stats[("auto_confirm", None)] == 1 and stats[("path", "rejected_by_human")] == 1


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "final_tag string, resolution_path string")
    got = {(r.kind, r.n) for r in report.summary_stats(empty).collect()}
    assert got == {("total", 0), ("auto_confirm", 0)}


def test_unknown_labels_pass_through(spark):
    df = spark.createDataFrame([("odd", "way", None)], "final_tag string, resolution_path string, req_period string")
    r = report.label_map(df).first()
    assert (r.tag_label, r.path_label) == ("odd", "way")


def test_revision_and_sinks(spark, tmp_path, rows):
    from specweave.sources import sinks

    df = spark.createDataFrame(
        [("c1", "x", "full_period", "validated"), (None, "y", "unresolved", "no_match")],
        "column_id string, eng_name string, final_tag string, resolution_path string",
    )
    before = spark.createDataFrame([("c1", "not_found")], "column_id string, tag string")
    at = F.lit(datetime.datetime(2024, 5, 6, 7, 8))
    lines = report.revision_records(df, before, at)
    assert rows(lines.drop("created_at")) == [
        ("c1", "not_found", "full_period", "resolution_path=validated"),
        ("y", None, "unresolved", "resolution_path=no_match"),
    ]
    path = str(tmp_path / "audit")
    for run_id in ("r1", "r2", "r1"):  # a run that is repeated leaves its records once
        sinks.audit_append(lines, path, run_id)
    assert spark.read.parquet(path).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 2)]
    assert sinks.output_name("a/b.c.xlsx", datetime.datetime(2024, 5, 6, 7, 8)) == "a/b.c(output)_20240506_0708"
    assert sinks.output_name(None, datetime.datetime(2024, 5, 6, 7, 8)) == "./output(output)_20240506_0708"


def test_a_period_is_cut_and_compared_once(spark):
    rows = report.report_rows(
        C.classify(spark.createDataFrame([], IN)).selectExpr(
            "*", "'a' eng_name", "'b' local_name", "'c' description", "'d' req_type", "'e' spec_type", "'f' table_id",
            "'matched' match_status", "'g' match_evidence", "'h' unresolved_reason", "'i' resolution_path", "'j' llm_evidence",
        )
    )
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1 and plan.count("try_cast") + plan.count("cast(get(") <= 4, plan


@pytest.mark.parametrize("name,stored", [("report_sink", 3), ("run_results", 2)])
def test_runs_of_one_report_compute_it_once(spark, monkeypatch, name, stored):
    from conftest import SF
    from specweave.queries import REGISTRY, checking

    calls, sinks = [], []
    reported, sink = checking.reported, checking.sinks.report_sink
    monkeypatch.setattr(checking, "reported", lambda i: calls.append(1) or reported(i))
    monkeypatch.setattr(
        checking.sinks, "report_sink",
        lambda df, *a: sinks.append(df.select("*")._jdf.queryExecution().optimizedPlan().toString()) or sink(df, *a),
    )
    REGISTRY[name](spark, SF)
    assert len(calls) == 1 and len(sinks) == stored
    assert all("InMemoryRelation" in plan or "Join" not in plan for plan in sinks)
