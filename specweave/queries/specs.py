"""Queries over sheets and specification rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import blank_to_null, fold_name, nan_to_null
from specweave.operators import spec
from specweave.queries.inputs import TABLES, Inputs
from specweave.queries.oracle import cte, quoted
from specweave.queries.registry import query
from specweave.sources import sheets, tables


def joined(column: str, sep: str = ","):
    return F.array_join(column, sep).alias(column)


@query(
    "spec_grid_scan",
    "select spec_id, row_idx, len(cells) n_cells, array_to_string(cells, '|') line from spec_cells "
    "where len(list_filter(cells, lambda c: c is not null)) > 0",
)
def _(i: Inputs) -> DataFrame:
    grid = sheets.spec_grid_scan(i["spec_cells"])
    return grid.select(
        "spec_id", "row_idx", F.size("cells").cast("long").alias("n_cells"),
        F.array_join("cells", "|").alias("line"),
    )


LOADED = ["customer", "orders", "lineitem", "part", "supplier", "events"]


@query(
    "table_load",
    "\nunion all ".join(f"select 'raw_{t}' table_id, count(*) row_count from {t}" for t in LOADED),
)
def _(i: Inputs) -> DataFrame:
    loaded = tables.load_tables(i.spark, {f"raw_{t}": f"{i.folder}/{t}.parquet" for t in LOADED})
    return tables.row_counts(loaded)


@query("table_row_counts", "select table_id, row_count from row_counts")
def _(i: Inputs) -> DataFrame:
    return tables.row_counts(i.tables())


@query(
    "catalog_snapshot",
    "select s.table_id, s.column_name, s.data_type, s.ordinal, r.row_count "
    "from snapshot s join row_counts r on s.table_id = r.table_id",
)
def _(i: Inputs) -> DataFrame:
    real = i.tables(TABLES)
    return tables.catalog_snapshot(i.spark, real).join(tables.row_counts(real), "table_id")


def _hits(text: str) -> str:
    return " + ".join(
        "cast((" + " or ".join(f"contains({text}, {quoted(w.lower())})" for w in words) + ") as int)"
        for words in M.HEADER_KEYWORDS.values()
    )


cte(
    "found_headers",
    f"""select spec_id, min(case when {_hits("lower(array_to_string(cells, ' '))")} >= {M.HEADER_MIN_HITS}
  then row_idx end) header_row from spec_cells where row_idx < {M.HEADER_SCAN_ROWS} group by spec_id""",
)


@query(
    "header_detect",
    "select spec_id, header_row, case when header_row is null then 'no_header' else 'ok' end status "
    "from found_headers",
)
def _(i: Inputs) -> DataFrame:
    return spec.header_detect(i["spec_cells"])


_FIELDS = list(M.HEADER_KEYWORDS)
_N_CELLS = 5


def _pick(at: int) -> str:
    """The first free field that cell ``at`` mentions, as a number."""
    text = f"lower(trim(cells[{at}]))"
    whens = []
    for f, words in enumerate(M.HEADER_KEYWORDS.values()):
        hit = " or ".join(f"contains({text}, {quoted(w.lower())})" for w in words)
        free = " and ".join(f"p{k} <> {f}" for k in range(1, at)) or "true"
        whens.append(f"when ({hit}) and {free} then {f}")
    return f"case {' '.join(whens)} else -1 end"


_steps = "select h.spec_id, h.header_row, g.cells from found_headers h join spec_cells g " \
    "on g.spec_id = h.spec_id and g.row_idx = h.header_row"
for _at in range(1, _N_CELLS + 1):
    _steps = f"select *, {_pick(_at)} p{_at} from ({_steps}) s{_at}"
_positions = ", ".join(
    "case " + " ".join(f"when p{at} = {f} then {at - 1}" for at in range(1, _N_CELLS + 1)) + f" end {name}"
    for f, name in enumerate(_FIELDS)
)
cte("mapped_headers", f"select spec_id, header_row, {_positions} from ({_steps}) z")
cte(
    "usable_specs",
    "select *, array_to_string(list_filter(["
    + ", ".join(f"case when {f} is null then '{f}' end" for f in M.REQUIRED_FIELDS)
    + "], lambda x: x is not null), ',') missing from mapped_headers",
)


def _mapping(i: Inputs) -> DataFrame:
    grid = i["spec_cells"]
    return spec.header_mapping(grid, spec.header_detect(grid))


@query("header_mapping", f"select spec_id, header_row, {', '.join(_FIELDS)} from mapped_headers")
def _(i: Inputs) -> DataFrame:
    return _mapping(i)


@query(
    "required_fields",
    "select spec_id, missing, case when missing = '' then 'ok' else 'missing_field' end status from usable_specs",
)
def _(i: Inputs) -> DataFrame:
    return spec.required_fields(_mapping(i)).select("spec_id", joined("missing"), "status")


cte(
    "sheet_rows",
    "select g.spec_id, g.row_idx, "
    + ", ".join(f"cells[m.{f} + 1] {f}" for f in _FIELDS)
    + " from spec_cells g join usable_specs m on g.spec_id = m.spec_id where m.missing = '' "
    "and g.row_idx > m.header_row and len(list_filter(cells, lambda c: c is not null)) > 0",
)


def _checked_sql(rows: str) -> str:
    missing = ", ".join(
        f"case when {f} is null or trim({f}) in ('', 'nan') then '{f}' end" for f in M.REQUIRED_FIELDS
    )
    return f"select *, array_to_string(list_filter([{missing}], lambda x: x is not null), ',') missing from {rows}"


cte("checked_rows", _checked_sql("sheet_rows"))
cte("checked_specs", _checked_sql("spec_rows"))


def _checked(i: Inputs) -> DataFrame:
    grid = i["spec_cells"]
    return spec.row_validate(spec.extract_rows(grid, spec.required_fields(_mapping(i))))


@query(
    "row_validate",
    f"select spec_id, row_idx, {', '.join(_FIELDS)}, missing, missing = '' valid from checked_rows",
)
def _(i: Inputs) -> DataFrame:
    return _checked(i).withColumn("missing", F.array_join("missing", ","))


@query(
    "parse_stats",
    """select s.spec_id, coalesce(total, 0) total, coalesce(parsed, 0) parsed,
  coalesce(total, 0) - coalesce(parsed, 0) failed, round(coalesce(parsed * 1.0e0 / total, 0), 6) success_rate
from (select spec_id from usable_specs where missing = '') s left join (
  select spec_id, count(*) total, sum(case when missing = '' then 1 else 0 end)::bigint parsed
  from checked_rows group by spec_id) c on c.spec_id = s.spec_id""",
)
def _(i: Inputs) -> DataFrame:
    usable = spec.required_fields(_mapping(i)).where("status = 'ok'")
    stats = spec.parse_stats(_checked(i), usable)
    return stats.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "parse_stats_bulk",
    """select spec_id, count(*) total, sum(case when missing = '' then 1 else 0 end)::bigint parsed,
  sum(case when missing = '' then 0 else 1 end)::bigint failed,
  round(avg(case when missing = '' then 1.0e0 else 0 end), 6) success_rate from checked_specs group by spec_id""",
)
def _(i: Inputs) -> DataFrame:
    stats = spec.parse_stats(spec.row_validate(i["spec_rows"]))
    return stats.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "spec_preview",
    """select spec_id, row_idx, eng_name, missing, valid, preview_no from (
  select *, missing = '' valid, row_number() over (partition by spec_id, missing = '' order by row_idx) preview_no
  from checked_specs) x where preview_no <= case when valid then 10 else 20 end""",
)
def _(i: Inputs) -> DataFrame:
    shown = spec.spec_preview(spec.row_validate(i["spec_rows"]))
    return shown.select(
        "spec_id", "row_idx", "eng_name", joined("missing"), "valid",
        F.col("preview_no").cast("long").alias("preview_no"),
    )


@query(
    "candidate_tables",
    """select spec_id, row_idx, coalesce(t, '') candidate_tables from requests r left join (
  select column_name, string_agg(table_id, ',' order by table_id) t from snapshot group by column_name) s
  on s.column_name = trim(r.eng_name)""",
)
def _(i: Inputs) -> DataFrame:
    found = spec.candidate_tables(i["requests"], tables.catalog_snapshot(i.spark, i.tables()))
    return found.select("spec_id", "row_idx", joined("candidate_tables"))


_NULLS = """select event_id, case when event_id % 9 = 0 then cast('NaN' as double) else value end v,
  case event_id % 4 when 0 then null when 1 then '' when 2 then '  ' else event_type end t from events"""


@query(
    "null_normalise",
    f"""select event_id, case when isnan(v) then null else v end v,
  case when trim(t) = '' then null else t end t from ({_NULLS}) x""",
)
def _(i: Inputs) -> DataFrame:
    raw = i.sql(_NULLS, "events")
    return raw.select("event_id", nan_to_null(F.col("v")).alias("v"), blank_to_null(F.col("t")).alias("t"))


@query(
    "name_normalise",
    "select doc_id, regexp_replace(lower(text), '[^a-z0-9가-힣]', '', 'g') folded from documents",
)
def _(i: Inputs) -> DataFrame:
    return i["documents"].select("doc_id", fold_name(F.col("text")).alias("folded"))
