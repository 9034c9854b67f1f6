"""Sheets of several runs in one plan, their lists by reference, and what is stored and freed."""

import os

from pyspark.sql import functions as F

from specweave.operators import spec
from specweave.plans.sheets import SHEET, keyed, read_sheets, store_run, unkeyed
from specweave.queries.inputs import Inputs
from specweave.queries.whole import _world, runs_over_sheets
from specweave.session import Kept

SF = "/root/testdata/sf0.001"
CELLS = "run_id string, spec_id string, row_idx long, cells array<string>"


def test_keys_of_runs_stay_apart(spark):
    rows = [("a", "1"), ("a", None), (None, "1"), (None, None), ('a"}', "b,"), ("a", "1")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "run_id string, spec_id string, n long")
    inside = keyed(df)
    assert inside.columns == ["spec_id", "n"] and inside.select("spec_id").distinct().count() == 5
    assert sorted((r.n, r.run_id, r.spec_id) for r in unkeyed(inside).collect()) == [(i, *r) for i, r in enumerate(rows)]


def test_one_sheet_id_in_two_runs(spark):
    head = ["english", "korean", "desc", "type", "period"]
    cells = [("r1", "s", 0, head), ("r1", "s", 1, ["x", "l", "d", "INT", None]), ("r1", "s", 2, ["y", " ", "d", "INT", None])]
    cells += [("r2", "s", 0, ["notes"]), ("r2", "s", 1, head[::-1]), ("r2", "s", 2, [None, "INT", "d", "l", "z"]), ("r2", "s", 3, [None] * 5)]
    cells += [("r2", "none", 0, ["a", "b"]), ("r2", "empty", 0, [None, None]), ("r3", "few", 0, ["english", "desc", "type"]), ("r3", "few", 1, ["x", "d", "t"])]
    read = read_sheets(spark.createDataFrame(cells, CELLS).repartition(3))
    got = {(r.run_id, r.spec_id): (r.status, r.total, r.parsed, r.failed) for r in unkeyed(read.sheets).collect()}
    assert got == {
        ("r1", "s"): ("ok", 2, 1, 1), ("r2", "s"): ("ok", 1, 1, 0), ("r2", "none"): ("no_header", 0, 0, 0),
        ("r2", "empty"): ("no_header", 0, 0, 0), ("r3", "few"): ("missing_field", 0, 0, 0),
    }
    assert sorted((r.run_id, r.row_idx, r.eng_name) for r in unkeyed(read.rows).collect()) == [("r1", 1, "x"), ("r2", 2, "z")]
    assert [(r.run_id, r.row_idx, r.missing) for r in unkeyed(read.failed).collect()] == [("r1", 2, ["local_name"])]
    assert read_sheets(spark.createDataFrame([], CELLS)).sheets.count() == 0


def test_lists_of_hubs_are_kept_once(spark):
    """A name that very many tables hold: the list is a table, rows carry its length only."""
    snapshot = spark.range(2000).select(F.concat(F.lit("t"), "id").alias("table_id"), F.lit("key").alias("column_name"))
    rows = spark.range(3000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 > 0, " key ").alias("eng_name"))
    assert spec.holders_of(rows, snapshot).count() == 2000
    counted = spec.holder_counts(rows, snapshot)
    assert {(r[0], r[1]) for r in counted.groupBy("n_candidate_tables").count().collect()} == {(0, 1000), (2000, 2000)}
    assert not any(f.dataType.typeName() == "array" for f in counted.schema)


def test_stored_whole_and_freed(spark, tmp_path):
    i = Inputs(spark, SF)
    path = str(tmp_path / "out")
    with Kept(spark, str(tmp_path / "shared")) as keep:
        done = runs_over_sheets(i, keep)
        assert os.path.isdir(keep.folder)
        store_run(done, path)
        before = sorted(map(str, spark.read.parquet(f"{path}/report").collect()))
        store_run(done, path)  # a run that is repeated replaces its own
    assert not os.path.exists(keep.folder)
    report = spark.read.parquet(f"{path}/report")
    assert sorted(map(str, report.collect())) == before and {*SHEET, "row_idx", "tag_label"} <= set(report.columns)
    assert report.select(*SHEET, "row_idx").distinct().count() == report.count() > 0
    sheets = spark.read.parquet(f"{path}/sheets").collect()
    assert {r.status for r in sheets} == {"ok", "missing_field", "no_header"}
    failed = spark.read.parquet(f"{path}/failed")
    assert sum(r.total for r in sheets) == sum(r.parsed for r in sheets) + failed.count()
    # relations of each matched table, in full and once
    relations = spark.read.parquet(f"{path}/relations")
    lengths = {r.table_id: r["count"] for r in relations.groupBy("table_id").count().collect()}
    for r in report.where("source_table is not null").select("source_table", "n_relationships").distinct().collect():
        assert lengths[r.source_table] == r.n_relationships


def test_kept_without_shared_folder_is_unpersisted(spark):
    keep = Kept(spark)
    if keep.folder is None:
        df = keep(spark.range(10))
        assert df.is_cached and df.count() == 10
        keep.free()
        assert not df.is_cached
    assert "catalog" in _world(Inputs(spark, SF))
