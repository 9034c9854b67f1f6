"""Sheets to stored report: many runs and many sheets in one plan.

A sheet is known by its run and its own id, a row by its place in the sheet.  Both go through every step as one
key, so that sheets of one id in several runs never mix; what comes out has ``run_id`` and ``spec_id`` again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.operators import match, spec
from specweave.plans.reconcile import Reconciliation, reconcile
from specweave.session import Kept
from specweave.sources.sheets import spec_grid_scan

SHEET = ["run_id", "spec_id"]
Keep = Callable[[DataFrame], DataFrame]
_KEY = "run_id string, spec_id string"


def sheet_key() -> Column:
    """Run and sheet as one text."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in SHEET)))


def keyed(df: DataFrame) -> DataFrame:
    """A table by run and sheet, as the steps inside take it."""
    return df.withColumn("spec_id", sheet_key()).drop("run_id")


def unkeyed(df: DataFrame) -> DataFrame:
    """The same table with ``run_id`` and ``spec_id`` apart, in front."""
    rest = [c for c in df.columns if c != "spec_id"]
    key = F.from_json("spec_id", _KEY)
    return df.select(*(key[c].alias(c) for c in SHEET), *rest)


@dataclass
class Sheets:
    """What the cells of sheets say, by key."""

    sheets: DataFrame    # every sheet: status, header_row, missing fields, row counts
    rows: DataFrame      # rows that can be matched
    failed: DataFrame    # rows without a required field
    preview: DataFrame   # the first failed and the first usable rows of each sheet


def read_sheets(cells: DataFrame, keep: Keep = lambda df: df) -> Sheets:
    """Cells (``run_id, spec_id, row_idx, cells``) to rows, of all sheets at once.  ``keep`` is applied to the
    checked rows, which are read more than once."""
    grid = spec_grid_scan(keyed(cells))
    headers = spec.header_detect(grid)
    mapping = spec.required_fields(spec.header_mapping(grid, headers))
    checked = keep(spec.row_validate(spec.extract_rows(grid, mapping)))
    known = headers.select("spec_id", "header_row", F.col("status").alias("found")).join(
        mapping.select("spec_id", "missing", "status"), "spec_id", "left"
    )
    # a sheet whose first rows are empty has no header either
    known = keyed(cells).select("spec_id").distinct().join(known, "spec_id", "left")
    status = F.coalesce("status", "found", F.lit("no_header"))
    known = known.select("spec_id", status.alias("status"), "header_row", "missing")
    stats = spec.parse_stats(checked, known.select("spec_id"))
    return Sheets(
        sheets=known.join(stats, "spec_id"),
        rows=spec.parsed_rows(checked),
        failed=spec.failed_rows(checked),
        preview=spec.spec_preview(checked),
    )


@dataclass
class SheetsRun:
    """All outputs of runs over sheets, by ``run_id`` and ``spec_id``."""

    sheets: DataFrame
    failed: DataFrame
    preview: DataFrame
    report: DataFrame      # with n_candidate_tables and n_relationships
    holders: DataFrame     # (wanted, table_id): lists of candidate tables, by name
    relations: DataFrame   # (table_id, ...): lists of relations, by matched table
    run: Reconciliation    # everything else, with run and sheet as one key (`unkeyed`)


def sheets_to_report(
    cells: DataFrame,
    snapshot: DataFrame,
    relationships: DataFrame,
    responses: DataFrame,
    decisions: DataFrame,
    type_decisions: DataFrame,
    keep: Kept,
    **world,
) -> SheetsRun:
    """Cells to report.  Replies and decisions are by ``run_id, spec_id, row_idx``; ``world`` takes what
    :func:`reconcile` needs beside them.  Lists of a hub, a name that many tables hold or a table with many
    relations, stay in tables of their own; rows carry how long they are."""
    read = read_sheets(cells, keep)
    rows = read.rows
    done = reconcile(
        rows=rows, snapshot=snapshot, responses=keyed(responses), decisions=keyed(decisions),
        type_decisions=keyed(type_decisions), keep=keep, **world,
    )
    report = keep(done.report)
    counted = match.relationship_counts(spec.holder_counts(report, snapshot), relationships, "source_table")
    return SheetsRun(
        sheets=unkeyed(read.sheets),
        failed=unkeyed(read.failed),
        preview=unkeyed(read.preview),
        report=unkeyed(counted),
        holders=spec.holders_of(rows, snapshot),
        relations=match.relations_of(report.select(F.col("source_table").alias("table_id")), relationships),
        run=done,
    )


def store_run(done: SheetsRun, path: str) -> str:
    """Every table of the runs below ``path``, one folder a run; writing a run again replaces it and leaves others.

    The lists that report rows refer to are stored once for all runs written together.
    """
    for name in ("sheets", "failed", "preview", "report"):
        rows = getattr(done, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("run_id").parquet(f"{path}/{name}")
    for name in ("holders", "relations"):
        getattr(done, name).write.mode("overwrite").parquet(f"{path}/{name}")
    return path
