import pytest
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import spec
from specweave.sources import sheets, tables

GRID = "spec_id string, row_idx long, cells array<string>"


@pytest.fixture
def grid(spark):
    return spark.createDataFrame(
        [
            ("a", 0, ["title", None, None, None, None]),
            ("a", 1, ["English Name", "KOREAN", "Description", "Type", "Period"]),
            ("a", 2, ["x", "엑스", "an x", "INTEGER", "202401~202402"]),
            ("a", 3, [None, None, None, None, None]),
            ("a", 4, ["y", " ", "nan", None, None]),
            ("b", 0, ["english", "period", "desc", "free", "text"]),
            ("b", 1, ["x", "", "", "", ""]),
            ("c", 0, ["nothing", "to", "see", None, None]),
            ("d", 2, ["요구기간", "타입", "설명", "한글", "영문"]),
            ("d", 3, ["202401~", "INTEGER", "d", "k", "z"]),
        ],
        GRID,
    )


def test_headers(grid, rows):
    found = spec.header_detect(grid)
    assert rows(found) == [("a", 1, "ok"), ("b", 0, "ok"), ("c", None, "no_header"), ("d", 2, "ok")]
    mapping = spec.header_mapping(grid, found)
    assert rows(mapping) == [
        ("a", 1, 0, 1, 2, 3, 4), ("b", 0, 0, None, 2, None, 1), ("d", 2, 4, 3, 2, 1, 0),
    ]
    status = spec.required_fields(mapping).select("spec_id", "missing", "status")
    assert rows(status) == [
        ("a", [], "ok"), ("b", ["local_name", "req_type"], "missing_field"), ("d", [], "ok"),
    ]


def test_a_header_takes_only_one_field_and_a_field_only_one_header(spark, rows):
    grid = spark.createDataFrame(
        [("s", 0, ["type of description", "desc", "type", "english korean", "korean"])], GRID
    )
    got = spec.header_mapping(grid, spec.header_detect(grid)).drop("spec_id", "header_row")
    # the first header mentions description before type, so type is taken by the third
    assert rows(got) == [(3, 4, 0, 2, None)]


def test_rows_are_validated_and_counted(grid, rows):
    mapping = spec.required_fields(spec.header_mapping(grid, spec.header_detect(grid)))
    checked = spec.row_validate(spec.extract_rows(grid, mapping))
    assert rows(spec.parsed_rows(checked).select("spec_id", "row_idx", "eng_name", "req_period")) == [
        ("a", 2, "x", "202401~202402"), ("d", 3, "z", "202401~"),
    ]
    assert rows(spec.failed_rows(checked).select("spec_id", "row_idx", "missing")) == [
        ("a", 4, ["local_name", "description", "req_type"])
    ]
    assert rows(spec.parse_stats(checked, mapping)) == [
        ("a", 2, 1, 1, 0.5), ("b", 0, 0, 0, 0.0), ("d", 1, 1, 0, 1.0),
    ]


def test_preview_bounds(spark):
    many = spark.range(200).select(
        F.lit("s").alias("spec_id"), F.col("id").alias("row_idx"), (F.col("id") % 2 == 0).alias("valid")
    )
    shown = spec.spec_preview(many)
    assert shown.where("valid").count() == 10 and shown.where("not valid").count() == 20


def test_candidate_tables(spark, rows):
    snap = tables.catalog_snapshot(
        spark, {"t1": spark.sql("select 1 x, 'a' y"), "t2": spark.sql("select 1D x, array(1.0F) z")}
    )
    assert ("t2", "z", "FLOAT[]", 2) in rows(snap) and ("t2", "x", "DOUBLE", 1) in rows(snap)
    asked = spark.createDataFrame([("s", 1, " x "), ("s", 2, "X")], "spec_id string, row_idx long, eng_name string")
    got = spec.candidate_tables(asked, snap).select("row_idx", "candidate_tables")
    assert rows(got) == [(1, ["t1", "t2"]), (2, [])]


def test_grid_scan_and_csv_with_mark(spark, rows, tmp_path):
    wide = spark.createDataFrame([(1, "a", None), (2, None, None)], "n long, p string, q string")
    cells = sheets.as_cells(wide.withColumn("s", F.lit("s")), "s", "n", ["p", "q"])
    assert rows(sheets.spec_grid_scan(cells)) == [("s", 1, ["a", None])]
    path = tmp_path / "eval.csv"
    path.write_bytes('﻿name,note\nx,"a, ""b""\nc"\n'.encode())
    df = sheets.read_csv_with_header(spark, str(path))
    assert df.columns == ["name", "note"] and rows(df) == [("x", 'a, "b"\nc')]


def test_tables_are_saved_under_their_names(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    loaded = tables.load_tables(spark, {"raw_three": str(tmp_path / "in")})
    assert tables.row_counts(loaded).collect()[0] == ("raw_three", 3)
    tables.save_tables(loaded)
    tables.save_tables(loaded)  # a second load replaces the first
    assert spark.table("raw_three").count() == 3
    spark.sql("drop table raw_three")


def test_header_keywords_cover_the_five_fields():
    assert list(M.HEADER_KEYWORDS) == M.SPEC_FIELDS
