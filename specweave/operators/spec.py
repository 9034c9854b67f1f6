"""Specification sheets: headers, rows, validation, statistics, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import is_blank, strip

Keywords = dict[str, list[str]]


def drop_empty_rows(grid: DataFrame) -> DataFrame:
    return grid.where(F.exists("cells", lambda c: c.isNotNull()))


def _mentions(text: Column, words: list[str]) -> Column:
    """Whether a lower-cased text contains one of the words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word.lower()))
    return hit


def header_detect(grid: DataFrame, keywords: Keywords = M.HEADER_KEYWORDS) -> DataFrame:
    """(spec_id, header_row, status): the first of rows 0–2 naming three or more fields."""
    text = F.lower(F.array_join("cells", " "))
    hits = sum((_mentions(text, words).cast("int") for words in keywords.values()), F.lit(0))
    return (
        grid.where(F.col("row_idx") < M.HEADER_SCAN_ROWS)
        .groupBy("spec_id")
        .agg(F.min(F.when(hits >= M.HEADER_MIN_HITS, F.col("row_idx"))).alias("header_row"))
        .withColumn(
            "status", F.when(F.col("header_row").isNull(), "no_header").otherwise("ok")
        )
    )


def header_mapping(
    grid: DataFrame, headers: DataFrame, keywords: Keywords = M.HEADER_KEYWORDS
) -> DataFrame:
    """(spec_id, header_row, <field> position ...): each header, left to right, takes the
    first free field it mentions; null where no header was found for a field."""
    fields = list(keywords)

    def place(taken: Column, at: Column) -> Column:
        text = F.lower(strip(F.get("cells", at)))
        field = F.lit(-1)
        for f in reversed(range(len(fields))):
            free = F.get(taken, F.lit(f)) < 0
            field = F.when(free & _mentions(text, keywords[fields[f]]), F.lit(f)).otherwise(field)
        return F.transform(taken, lambda v, i: F.when(i == field, at).otherwise(v))

    top = grid.where(F.col("row_idx") < M.HEADER_SCAN_ROWS).join(
        headers.where("status = 'ok'"), "spec_id"
    )
    positions = F.aggregate(
        F.sequence(F.lit(0), F.size("cells") - 1),
        F.array_repeat(F.lit(-1), len(fields)),
        place,
    )
    return top.where(F.col("row_idx") == F.col("header_row")).select(
        "spec_id",
        "header_row",
        *[F.nullif(F.get(positions, F.lit(i)), F.lit(-1)).alias(f) for i, f in enumerate(fields)],
    )


def required_fields(mapping: DataFrame, required: list[str] = M.REQUIRED_FIELDS) -> DataFrame:
    """The mapping with ``missing`` required fields and a spec ``status``."""
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in required]))
    return mapping.withColumn("missing", missing).withColumn(
        "status", F.when(F.size("missing") > 0, "missing_field").otherwise("ok")
    )


def extract_rows(grid: DataFrame, mapping: DataFrame, fields: list[str] = M.SPEC_FIELDS) -> DataFrame:
    """spec_rows: the cells under each mapped header, of usable specs only."""
    usable = mapping.where("status = 'ok'").select(
        "spec_id", "header_row", *[F.col(f).alias(f"at_{f}") for f in fields]
    )
    return (
        drop_empty_rows(grid)
        .join(usable, "spec_id")
        .where(F.col("row_idx") > F.col("header_row"))
        .select("spec_id", "row_idx", *[F.get("cells", F.col(f"at_{f}")).alias(f) for f in fields])
    )


def row_validate(rows: DataFrame, required: list[str] = M.REQUIRED_FIELDS) -> DataFrame:
    """Adds ``missing`` (array of field names) and ``valid``."""
    missing = F.array_compact(F.array(*[F.when(is_blank(F.col(f)), F.lit(f)) for f in required]))
    return rows.withColumn("missing", missing).withColumn("valid", F.size("missing") == 0)


def parsed_rows(checked: DataFrame) -> DataFrame:
    return checked.where("valid").drop("missing", "valid")


def failed_rows(checked: DataFrame) -> DataFrame:
    return checked.where("not valid").drop("valid")


def parse_stats(checked: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """(spec_id, total, parsed, failed, success_rate); specs without rows count 0."""
    counts = checked.groupBy("spec_id").agg(
        F.count("*").alias("total"), F.count_if("valid").alias("parsed")
    )
    if specs is not None:
        counts = specs.select("spec_id").join(counts, "spec_id", "left").na.fill(0)
    return counts.select(
        "spec_id",
        "total",
        "parsed",
        (F.col("total") - F.col("parsed")).alias("failed"),
        F.coalesce(F.try_divide("parsed", "total"), F.lit(0.0)).alias("success_rate"),
    )


def candidate_tables(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds ``candidate_tables``: real tables holding a column of that trimmed name."""
    holders = snapshot.groupBy(F.col("column_name").alias("wanted")).agg(
        F.sort_array(F.collect_set("table_id")).alias("candidate_tables")
    )
    none = F.array().cast("array<string>")
    return (
        rows.withColumn("wanted", strip(F.col("eng_name")))
        .join(holders, "wanted", "left")
        .drop("wanted")
        .withColumn("candidate_tables", F.coalesce("candidate_tables", none))
    )


def holders_of(names: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(wanted, table_id): the real tables that hold a column of each trimmed name asked for.

    A list by reference: it is kept once, however many rows ask for the name, and joined where it is read.
    """
    asked = names.select(strip(F.col("eng_name")).alias("wanted")).where("wanted is not null").distinct()
    held = snapshot.select(F.col("column_name").alias("wanted"), "table_id").distinct()
    return held.join(asked, "wanted", "left_semi")


def holder_counts(rows: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Adds ``n_candidate_tables``, how many real tables hold a column of the row's name."""
    counts = holders_of(rows, snapshot).groupBy("wanted").agg(F.count("*").alias("n_candidate_tables"))
    joined = rows.withColumn("wanted", strip(F.col("eng_name"))).join(counts, "wanted", "left").drop("wanted")
    return joined.withColumn("n_candidate_tables", F.coalesce("n_candidate_tables", F.lit(0)))


def spec_preview(checked: DataFrame, failed: int = 20, parsed: int = 10) -> DataFrame:
    """The first ``failed`` invalid and the first ``parsed`` valid rows of each spec."""
    order = Window.partitionBy("spec_id", "valid").orderBy("row_idx")
    return (
        checked.withColumn("preview_no", F.row_number().over(order))
        # a plain bound first, so that only the head of each group is shuffled
        .where(F.col("preview_no") <= max(failed, parsed))
        .where(F.col("preview_no") <= F.when(F.col("valid"), parsed).otherwise(failed))
    )
