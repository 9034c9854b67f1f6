"""Inputs derived from the given tables, as SQL text that runs unchanged in both engines.

``DERIVED[name] = (text, names it reads)``.  A text may use ``{array}(...)`` for an array
literal.  Every text reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Column types of the given tables, for the oracle side of the schema snapshot.
SCHEMAS = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding FLOAT[], label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}

# Real tables with months; the others have none.
MONTH_COLUMNS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
# Declared types that differ from the real ones, and a declared column that does not exist.
OVERRIDES = [
    ("lineitem", "l_discount", "INTEGER"),
    ("orders", "o_totalprice", "VARCHAR"),
    ("events", "value", "BIGINT"),
]
GHOST = ("orders", "legacy_flag", "VARCHAR")

DERIVED: dict[str, tuple[str, list[str]]] = {
    # catalog; the same column_name sits in many tables
    "meta_columns": (
        """
select concat(p_brand, '.', p_name) column_id, p_brand table_id, p_name column_name,
  case min(p_size) % 4 when 0 then 'INTEGER' when 1 then 'BIGINT' when 2 then 'DOUBLE' else 'VARCHAR' end data_type,
  concat(p_name, ' | ', min(p_type)) description
from part group by p_brand, p_name""",
        ["part"],
    ),
    # 50 specs, one row per order with items, named after a part of the order: exact, first letter lost, words swapped, padded, unknown names; periods
    # absent, blank, contained, partial (with blanks), disjoint, malformed
    "spec_rows": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  case o_orderkey % 5 when 0 then p_name when 1 then substr(p_name, 2)
    when 2 then concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1))
    when 3 then concat(' ', p_name, ' ') else concat('zq', cast(o_orderkey % 97 as string)) end eng_name,
  case when o_orderkey % 13 = 0 then ' ' else o_orderpriority end local_name,
  case when o_orderkey % 17 = 0 then 'nan' else concat('about ', p_name) end description,
  case when o_orderkey % 11 = 0 then null else 'INTEGER' end req_type,
  case o_orderkey % 6 when 0 then null when 1 then '' when 2 then '199601~199612'
    when 3 then concat(cast(year(o_orderdate) * 100 + month(o_orderdate) as string), ' ~ 200512')
    when 4 then '201001~201012' else '199x~2000' end req_period
from orders join (select l_orderkey, min(l_partkey) first_part from lineitem group by l_orderkey) l
  on l_orderkey = o_orderkey
join part on p_partkey = first_part""",
        ["orders", "lineitem", "part"],
    ),
    # requests against the given tables' own columns
    "requests": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  case o_orderkey % 12 when 0 then 'o_orderdate' when 1 then ' l_shipdate ' when 2 then 'l_quantity'
    when 3 then 'event_type' when 4 then 'c_acctbal' when 5 then 'o_totalprice' when 6 then 'legacy_flag'
    when 7 then 'value' when 8 then 'l_discount' when 9 then 'O_ORDERDATE' when 10 then 'doc_id'
    else concat('zq', cast(o_orderkey % 97 as string)) end eng_name,
  o_orderpriority local_name, concat('about ', o_orderstatus) description, 'VARCHAR' req_type,
  case o_custkey % 6 when 0 then null when 1 then '' when 2 then '199601~199612'
    when 3 then concat(cast(year(o_orderdate) * 100 + month(o_orderdate) as string), ' ~ 202401')
    when 4 then '201001~201012' else case when o_custkey % 11 = 5 then '199x~2000' else '2001' end end req_period
from orders""",
        ["orders"],
    ),
    "type_decisions": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  case o_orderkey % 5 when 0 then 'approved' when 1 then 'approved' else 'rejected' end decision
from orders where o_orderkey % 5 <> 4""",
        ["orders"],
    ),
    # model replies; candidate ids are always c1, c2, c3
    "responses": (
        """
select event_id req_id, case event_id % 9
    when 0 then 'not json'
    when 1 then concat('```json', chr(10), '{"selected_column_id":"c1","confidence":0.95,"evidence":"f"}', chr(10), '```')
    when 2 then '{"selected_column_id":"c9","confidence":0.99,"evidence":"x"}'
    when 3 then '{"selected_column_id":"c1","confidence":1.4,"evidence":"x"}'
    when 4 then '{"selected_column_id":null,"confidence":0.93,"evidence":"n"}'
    when 5 then '{"evidence":"d"}'
    when 7 then '{"selected_column_id":"c1","confidence":"high","evidence":"x"}'
    when 8 then '{"selected_column_id":"c1","confidence":0.8,"evidence":"x"} and more'
    else concat('{"selected_column_id":"c2","confidence":', cast(floor(value / 5) / 100 as string), ',"evidence":"v"}') end response,
  cast(event_id % 3 as int) attempt
from events""",
        ["events"],
    ),
    # decisions: one in four is still pending
    "decisions": (
        """
select event_id req_id, case event_id % 3 when 0 then 'approved' else 'rejected' end decision
from events where event_id % 4 <> 3""",
        ["events"],
    ),
    "pipeline_events": (
        "select user_id thread_id, event_id, ts, event_type node, value from events",
        ["events"],
    ),
    # sheets: one per nation, header in row 0, 1 or 2 or nowhere, every tenth row empty
    "spec_cells": (
        """
select cast(n_nationkey as string) spec_id, cast(0 as bigint) row_idx,
  case when n_nationkey % 3 = 0 then header else title end cells
from headed
union all select cast(n_nationkey as string), cast(1 as bigint),
  case when n_nationkey % 3 = 1 then header else title end from headed
union all select cast(n_nationkey as string), cast(2 as bigint),
  case when n_nationkey % 3 = 2 then header else title end from headed
union all select cast(c_nationkey as string), c_custkey + 3,
  case when c_custkey % 10 = 9 then {array}(cast(null as string), null, null, null, null)
    else {array}(c_name, c_mktsegment,
      case c_custkey % 7 when 0 then null when 1 then '  ' when 2 then 'nan' else concat('about ', c_name) end,
      case when c_custkey % 4 = 0 then 'DOUBLE' else 'VARCHAR' end,
      case when c_custkey % 3 = 0 then '199601~199612' else null end) end
from customer""",
        ["headed", "customer"],
    ),
    "headed": (
        """
select n_nationkey, {array}(n_name, cast(null as string), null, null, null) title,
  case when n_nationkey % 8 = 7 then {array}('a', 'b', 'c', 'd', 'e')
    else case n_nationkey % 4
      when 0 then {array}('English Name', 'Korean Name', 'Description', 'Type', 'Period')
      when 1 then {array}('Column_Name', 'kor_name', 'desc', 'TYPE', '요구기간')
      when 2 then {array}('영문명', '한글명', '항목설명', 'type', 'type 2')
      else {array}('english', 'english period', 'desc', 'x', 'y') end end header
from nation""",
        ["nation"],
    ),
    # vectors as columns: a query vector is its own column's vector plus a share of the next
    "vec_columns": (
        """
select concat('c', cast(vec_id as string)) column_id, concat('t', cast(label as string)) table_id,
  coalesce(p_name, concat('plain ', cast(label as string))) column_name, 'VARCHAR' data_type,
  concat(coalesce(p_name, 'plain'), ' | ', coalesce(p_type, 'none')) description, vec_id, embedding
from embeddings left join part on p_partkey = vec_id""",
        ["embeddings", "part"],
    ),
    "vec_terms": (
        """
select concat('g', cast(vec_id as string)) term_id,
  case label when 0 then null when 1 then concat('x', cast(vec_id as string))
    else concat('c', cast(vec_id as string)) end linked_column_id, embedding
from embeddings""",
        ["embeddings"],
    ),
    "vec_asks": (
        """
select cast(a.vec_id % 5 as string) spec_id, a.vec_id row_idx, cast(a.vec_id as string) ask_id,
  case a.vec_id % 4 when 0 then substr(a.column_name, 2) when 1 then concat(a.column_name, 's')
    when 2 then concat(split_part(a.column_name, ' ', 2), ' ', split_part(a.column_name, ' ', 1))
    else concat('zq', cast(a.vec_id as string)) end eng_name,
  concat('about ', a.column_name) description, a.column_id home_id, a.embedding va,
  coalesce(b.embedding, a.embedding) vb,
  case a.vec_id % 5 when 0 then 0.3e0 when 1 then 0.9e0 when 2 then 1.1e0 when 3 then 1.4e0 else 5e0 end share
from vec_columns a left join vec_columns b on b.vec_id = a.vec_id + 1""",
        ["vec_columns"],
    ),
    "vec_replies": (
        """
select cast(vec_id % 5 as string) spec_id, vec_id row_idx, cast(attempt as int) attempt,
  case (vec_id + attempt) % 6
    when 0 then concat('{"selected_column_id":"c', cast(vec_id as string), '","confidence":0.95,"evidence":"near"}')
    when 1 then concat('{"selected_column_id":"c', cast(vec_id as string), '","confidence":0.8,"evidence":"maybe"}')
    when 2 then '{"selected_column_id":null,"confidence":0.75,"evidence":"none"}'
    when 3 then concat('{"selected_column_id":"c', cast(vec_id as string), '","confidence":0.5,"evidence":"weak"}')
    when 4 then concat('{"selected_column_id":"c', cast(vec_id as string), '","confidence":0.91,"evidence":"close"}')
    else 'not json' end response
from (select vec_id, 0 attempt from embeddings union all select vec_id, 1 from embeddings
  union all select vec_id, 2 from embeddings) e
where (vec_id + attempt * 5) % 23 <> 7""",
        ["embeddings"],
    ),
    "vec_decisions": (
        """
select cast(vec_id % 5 as string) spec_id, vec_id row_idx,
  case when label < 5 then 'approved' else 'rejected' end decision
from embeddings where vec_id % 7 <> 3""",
        ["embeddings"],
    ),
    # a whole run: exact, misspelled and unknown names of the given tables' columns
    "plan_rows": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  case o_orderkey % 10 when 0 then 'o_orderdate' when 1 then 'o_orderdat' when 2 then 'l_shipdat'
    when 3 then ' l_quantity ' when 4 then 'event_typ' when 5 then 'c_acctbal' when 6 then 'legacy_flags'
    when 7 then concat('zq', cast(o_orderkey % 97 as string)) when 8 then 'value' else 'o_totalpric' end eng_name,
  o_orderpriority local_name, concat('d', cast(o_custkey % 64 as string)) description, 'VARCHAR' req_type,
  case o_custkey % 5 when 0 then null when 1 then '199601~199612' when 2 then '202312 ~ 202401'
    when 3 then '199x~2000' else '201001~201012' end req_period
from orders""",
        ["orders"],
    ),
    # the rows of a whole run as sheets of three runs, in five layouts: headers in row 0, 1 or 2 in several orders,
    # without a type, and nowhere; some rows without description, some empty
    "sheet_cells": (
        """
select concat('r', cast(cast(spec_id as int) % 3 as string)) run_id, spec_id, row_idx + 3 row_idx,
  case cast(spec_id as int) % 5
    when 1 then {array}(req_period, said, req_type, local_name, eng_name)
    when 2 then {array}(cast(row_idx as string), eng_name, local_name, said, req_type, req_period)
    else {array}(eng_name, local_name, said, req_type, req_period) end cells
from (select *, case when row_idx % 29 = 0 then ' ' else description end said from plan_rows) p
union all
select concat('r', cast(cast(spec_id as int) % 3 as string)), spec_id, row_idx + 1000000000,
  {array}(cast(null as string), null, null)
from plan_rows where row_idx % 40 = 0
union all
select concat('r', cast(n % 3 as string)), cast(n as string), at,
  case when at <> case n % 5 when 1 then 1 when 2 then 2 else 0 end or n % 5 = 4 then {array}('title', cast(null as string), 'notes')
    else case n % 5 when 0 then {array}('English Name', 'Korean Name', 'Description', 'Type', 'Period')
      when 1 then {array}('Period', 'desc', 'TYPE', 'kor_name', 'Column_Name')
      when 2 then {array}('no', '영문명', '한글명', '항목설명', '타입', '시점')
      else {array}('English Name', 'Korean Name', 'Description', 'x', 'y') end end
from (select distinct cast(spec_id as int) n from plan_rows) s
cross join (select cast(0 as bigint) at union all select 1 union all select 2) rows""",
        ["plan_rows"],
    ),
    "plan_vectors": (
        "select concat('d', cast(vec_id as string)) description, vec_id, embedding from embeddings",
        ["embeddings"],
    ),
    "plan_replies": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx, cast(attempt as int) attempt, concat(
  '{"selected_column_id":', case o_orderkey % 4 when 0 then '"orders.o_orderdate"' when 1 then '"lineitem.l_shipdate"'
    when 2 then '"orders.legacy_flag"' else 'null' end,
  ',"confidence":', case (o_orderkey + attempt) % 5 when 0 then '0.95' when 1 then '0.8' when 2 then '0.5'
    when 3 then '0.93' else '0.75' end, ',"evidence":"seen"}') response
from (select o_orderkey, o_custkey, 0 attempt from orders union all select o_orderkey, o_custkey, 1 from orders
  union all select o_orderkey, o_custkey, 2 from orders) o
where (o_orderkey + attempt * 7) % 31 <> 4""",
        ["orders"],
    ),
    "plan_decisions": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  case when o_orderkey % 7 < 3 then 'approved' else 'rejected' end decision
from orders where o_orderkey % 7 <> 6""",
        ["orders"],
    ),
    # relations between supplier tables, from which suppliers ship parts together
    "relationships": (
        """
select distinct concat('t', cast(l_suppkey as string)) from_table_id,
  concat('t', cast(l_partkey % 120 as string)) to_table_id, l_returnflag join_key, '1:N' relation_type
from lineitem""",
        ["lineitem"],
    ),
    "placed_rows": (
        """
select cast(o_custkey % 50 as string) spec_id, o_orderkey row_idx,
  concat('t', cast(o_custkey % 150 as string)) table_id from orders""",
        ["orders"],
    ),
    # glossary drafts from the catalog; ids are unique per (table, name)
    "draft_terms": (
        """
select concat('term_', column_id) term_id, column_name canonical_term, column_name syn1, table_id syn2,
  description, column_id linked_column_id,
  case when length(column_id) % 3 = 0 then 'draft' when length(column_id) % 3 = 1 then 'llm_generated_reviewed'
    else 'manual' end source
from meta_columns""",
        ["meta_columns"],
    ),
}


def text_of(name: str, engine: str) -> str:
    return DERIVED[name][0].replace("{array}", {"spark": "array", "duckdb": "list_value"}[engine])


class Inputs:
    """The given tables of one folder and what is derived from them, as Spark DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._known[name]

    def tables(self, names: list[str] | None = None) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in names or TABLES}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in DERIVED:
            return self.table(name)
        if name not in self._known:
            self._views(DERIVED[name][1])
            self._known[name] = self.spark.sql(text_of(name, "spark"))
        return self._known[name]

    def _views(self, names: list[str]) -> None:
        for name in names:
            self[name].createOrReplaceTempView(name)

    def sql(self, text: str, *names: str) -> DataFrame:
        self._views(list(names))
        return self.spark.sql(text)
