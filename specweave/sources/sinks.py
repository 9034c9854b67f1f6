"""Writers.  Each returns the path written."""

from __future__ import annotations

import posixpath
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.model import REPORT_HEADINGS

ROW_KEYS = ["spec_id", "row_idx"]


def output_name(input_path: str | None, run_ts: datetime) -> str:
    """``dir/name(output)_YYYYMMDD_HHMM`` next to the input."""
    stamp = run_ts.strftime("%Y%m%d_%H%M")
    if not input_path:
        return f"./output(output)_{stamp}"
    folder, name = posixpath.split(input_path)
    stem = posixpath.splitext(name)[0]
    return posixpath.join(folder, f"{stem}(output)_{stamp}")


def output_names(specs: DataFrame, path: str, run_ts) -> DataFrame:
    """The same rule for many inputs: adds ``output_path`` to a table of paths."""
    stamp = F.date_format(run_ts, "yyyyMMdd_HHmm")
    bare = F.regexp_replace(F.col(path), r"(?<=[^/])\.[^./]*$", "")
    return specs.withColumn("output_path", F.concat(bare, F.lit("(output)_"), stamp))


def report_sink(
    report: DataFrame, path: str, run_id: str, fmt: str = "parquet", local_headings: bool = False
) -> str:
    """The ordered twelve-column report of a run behind the keys of its rows.

    One folder per run and final tag; writing a run again replaces it and leaves other runs.
    ``run_results`` reads the folder back.
    """
    out = report.select(*ROW_KEYS, *REPORT_HEADINGS)
    key = "final_tag"
    if local_headings:
        out, key = out.toDF(*ROW_KEYS, *REPORT_HEADINGS.values()), REPORT_HEADINGS[key]
    out.write.mode("overwrite").partitionBy(key).format(fmt).save(f"{path}/run_id={run_id}")
    return path


def metrics_sink(metrics: DataFrame, path: str) -> str:
    """One-row metrics as CSV (a single row, hence a single file)."""
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def review_rows(candidates: DataFrame) -> DataFrame:
    """The review file's columns with a blank ``approve``; lists joined by commas."""

    def listed(c: str):
        return F.array_join(c, ",").alias(c)

    return candidates.select(
        "term_id", "canonical_term", listed("original_synonyms"), listed("suggested_synonyms"),
        F.coalesce("domain", F.lit("")).alias("domain"), "linked_column_id",
        F.lit("").alias("approve"),
    )


def review_sink(candidates: DataFrame, path: str) -> str:
    review_rows(candidates).write.mode("overwrite").csv(path, header=True, emptyValue="")
    return path


def audit_append(records: DataFrame, path: str, run_id: str, at: str = "created_at") -> str:
    """Add a run's audit records, one folder per run and day; a run that is repeated replaces its own."""
    (
        records.withColumn("created_date", F.to_date(at))
        .write.mode("overwrite").partitionBy("created_date").parquet(f"{path}/run_id={run_id}")
    )
    return path
