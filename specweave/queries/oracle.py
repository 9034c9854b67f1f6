"""Composition of oracle SQL from shared common table expressions."""

from __future__ import annotations

import re

from specweave import model as M
from specweave.queries.inputs import DERIVED, GHOST, MONTH_COLUMNS, OVERRIDES, SCHEMAS, TABLES, text_of


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    def cell(v):
        return "null" if v is None else quoted(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) v({names})"


def printf(fmt: str, *args: str) -> str:
    """concat() with the arguments put in place of %d and %s."""
    pieces = re.split("%[ds]", fmt)
    out = [quoted(pieces[0])]
    for arg, piece in zip(args, pieces[1:], strict=True):
        out += [f"cast({arg} as varchar)", quoted(piece)]
    return "concat(" + ", ".join(out) + ")"


def case_of(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table.items()) + " end"


# name -> text; what a text reads is found by name
CTES: dict[str, str] = {name: text_of(name, "duckdb") for name in DERIVED}


def cte(name: str, text: str) -> None:
    CTES[name] = text


def with_ctes(body: str) -> str:
    """The body with every CTE it needs, in order of use."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + body


_COLUMNS = [
    (table, *column.rsplit(" ", 1), i)
    for table in TABLES
    for i, column in enumerate(SCHEMAS[table].split(", "), start=1)
]
cte("snapshot", values(_COLUMNS, "table_id, column_name, data_type, ordinal"))
cte("overrides", values(OVERRIDES, "table_id, column_name, declared_type"))
cte(
    "column_spec",
    f"""select concat(s.table_id, '.', s.column_name) column_id, s.table_id, s.column_name,
  coalesce(o.declared_type, s.data_type) data_type, concat(s.column_name, ' | ', s.table_id) description
from snapshot s left join overrides o on s.table_id = o.table_id and s.column_name = o.column_name
union all select '{GHOST[0]}.{GHOST[1]}', '{GHOST[0]}', '{GHOST[1]}', '{GHOST[2]}', '{GHOST[1]} | {GHOST[0]}'""",
)
cte(
    "retention",
    "\nunion all ".join(
        f"select '{t}' table_id, cast(min(year({c}) * 100 + month({c})) as int) ret_start, "
        f"cast(max(year({c}) * 100 + month({c})) as int) ret_end from {t}"
        for t, c in MONTH_COLUMNS.items()
    ),
)
cte(
    "row_counts",
    "\nunion all ".join(f"select '{t}' table_id, count(*) row_count from {t}" for t in TABLES),
)


def exact_cte(rows: str, catalog: str) -> str:
    return f"""select r.*, c.column_id, c.table_id, c.column_name, c.data_type,
  coalesce(c.n, 0) n_matches from {rows} r left join (
  select *, count(*) over (partition by column_name) n,
    row_number() over (partition by column_name order by table_id, column_id) k from {catalog}) c
  on c.column_name = trim(r.eng_name) and c.k = 1"""


cte("matched_requests", exact_cte("requests", "column_spec"))
def checked_cte(rows: str, decisions: str) -> str:
    """Existence, type and months of rows(table_id, column_name, data_type, ...)."""
    return f"""select m.*, m.data_type spec_type, s.data_type actual_type, s.data_type is not null col_exists,
  case when s.data_type is null then null when upper(s.data_type) = upper(m.data_type) then 'matched'
    when d.decision is null then 'pending' when d.decision = 'approved' then 'mismatch_confirmed'
    else 'mismatch_rejected' end type_match_status,
  case when s.data_type is not null then ret_start end ret_start,
  case when s.data_type is not null then ret_end end ret_end
from {rows} m
left join snapshot s on s.table_id = m.table_id and s.column_name = m.column_name
left join {decisions} d on d.spec_id = m.spec_id and d.row_idx = m.row_idx
left join retention t on t.table_id = m.table_id"""


cte("checked_requests", checked_cte("(select * from matched_requests where n_matches > 0)", "type_decisions"))


def parsed_cte(rows: str) -> str:
    return f"""select *, len(p) = 2 and (try_cast(p[1] as int) is null or try_cast(p[2] as int) is null) bad,
  case when len(p) = 2 then try_cast(p[1] as int) end req_start,
  case when len(p) = 2 then try_cast(p[2] as int) end req_end
from (select *, string_split(replace(req_period, ' ', ''), '~') p from {rows}) x"""


def compared_cte(rows: str) -> str:
    def pick(*five: str) -> str:
        a, b, c, d, e = five
        return (
            f"case when ret_start is null or ret_end is null then {a} "
            f"when req_start is null or req_end is null then {b} "
            f"when greatest(req_start, ret_start) > least(req_end, ret_end) then {c} "
            f"when req_start >= ret_start and req_end <= ret_end then {d} else {e} end"
        )

    lo, hi = "greatest(req_start, ret_start)", "least(req_end, ret_end)"
    tag = pick("'period_mismatch'", "'full_period'", "'period_mismatch'", "'full_period'", "'confirm_period'")
    evidence = pick(
        quoted(M.EV_NO_RETENTION),
        printf(M.EV_NO_REQUEST, "ret_start", "ret_end"),
        printf(M.EV_DISJOINT, "req_start", "req_end", "ret_start", "ret_end"),
        printf(M.EV_CONTAINED, "ret_start", "ret_end"),
        printf(M.EV_PARTIAL, lo, hi),
    )
    return f"""select *, {tag} period_tag, {pick('null', 'ret_start', 'null', 'req_start', lo)} fs,
  {pick('null', 'ret_end', 'null', 'req_end', hi)} fe, {evidence} period_evidence from {rows}"""


cte("parsed_requests", parsed_cte("checked_requests"))
cte("compared_requests", compared_cte("parsed_requests"))
_OPEN = "type_match_status = 'pending' or coalesce(bad, false)"


def classified_cte(rows: str) -> str:
    return f"""select *, case when not col_exists then 'not_found' when type_match_status = 'mismatch_rejected' then 'type_mismatch'
    when {_OPEN} then null else period_tag end final_tag,
  case when not col_exists then {quoted(M.EV_NOT_FOUND)}
    when type_match_status = 'mismatch_rejected' then {quoted(M.EV_TYPE_MISMATCH)}
    when {_OPEN} then null
    when type_match_status = 'mismatch_confirmed' then concat({printf(M.EV_TYPE_CONFIRMED, 'actual_type')}, period_evidence)
    else period_evidence end evidence,
  case when col_exists and type_match_status <> 'mismatch_rejected' and not ({_OPEN}) then fs end final_start,
  case when col_exists and type_match_status <> 'mismatch_rejected' and not ({_OPEN}) then fe end final_end,
  case when col_exists and type_match_status not in ('mismatch_rejected', 'pending') and coalesce(bad, false)
    then 'bad_period' end reject_reason
from {rows}"""


cte("classified", classified_cte("compared_requests"))
cte(
    "reported",
    f"""select spec_id, row_idx, eng_name, local_name, description, req_period, spec_type req_type, actual_type avail_type,
  case when final_start is not null and final_end is not null then concat(final_start, '~', final_end) end avail_period,
  table_id source_table, final_tag, evidence, 'validated' resolution_path, req_type asked_type, column_id
from classified where final_tag is not null
union all
select spec_id, row_idx, eng_name, local_name, description, req_period, req_type, null, null, null, 'unresolved',
  {quoted(M.EV_NO_CANDIDATE)}, 'no_match', req_type, null
from matched_requests where n_matches = 0""",
)
TAG_LABEL = (
    "case when final_tag = 'full_period' and (req_period is null or trim(req_period) = '') then "
    f"{quoted(M.FULL_PERIOD_NO_REQUEST_LABEL)} else coalesce({case_of('final_tag', M.TAG_LABELS)}, final_tag) end"
)
PATH_LABEL = f"coalesce({case_of('resolution_path', M.PATH_LABELS)}, resolution_path)"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of two columns as a row-wise dynamic programme."""
    return (
        f"list_last(list_reduce(string_split({a}, ''), lambda prev, ch: "
        f"list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur, "
        f"case when substr({b}, j, 1) = ch then prev[j] + 1 else greatest(prev[j + 1], cur[j]) end), "
        f"[cast(0 as bigint)]), list_transform(range(0, length({b}) + 1), lambda i: cast(0 as bigint))))"
    )


def ratio(a: str, b: str) -> str:
    return f"2.0 * {lcs(a, b)} / (length({a}) + length({b}))"


def token_sorted(column: str) -> str:
    return f"array_to_string(list_sort(string_split_regex(trim({column}), '\\s+')), ' ')"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])), 9)"
