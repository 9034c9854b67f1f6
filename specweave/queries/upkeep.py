"""Queries that build and maintain catalog, glossary and event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import catalog as cat
from specweave.operators import events as ev
from specweave.operators import glossary as G
from specweave.queries.checking import column_spec, scratch
from specweave.queries.inputs import TABLES, Inputs
from specweave.queries.oracle import case_of, cte, printf, quoted, values
from specweave.queries.registry import query
from specweave.sources import buckets, catalogs, sheets, sinks, tables
from specweave.streaming import log as streams

# Column names like parts of the given data: two words, a number, a customer segment.
_NAMES = """select distinct concat(replace(p_name, ' ', '_'), '_', cast(p_size as string), '_', lower(p_type)) column_name
from part union select distinct lower(replace(c_name, '#', '_')) from customer"""
# The user's dictionaries, taken from the data: half of the words are known, one is dropped.
_TOKENS = """select distinct w token, case when w = 'old' then '' else upper(w) end text from (
  select split_part(p_name, ' ', 1) w from part union all select split_part(p_name, ' ', 2) from part
  union all select 'customer' from customer) x where length(w) <> 4"""
_EXCEPTIONS = """select lower(replace(c_name, '#', '_')) column_name, c_mktsegment local_name,
  concat('segment ', c_mktsegment) description from customer where c_acctbal < 0"""

cte("raw_names", _NAMES)
cte("token_texts", _TOKENS)
cte("exception_texts", _EXCEPTIONS)
cte(
    "ruled_names",
    f"""select n.column_name, coalesce(e.local_name, r.ruled, n.column_name) local_name,
  coalesce(e.description, {printf(M.RULE_DESCRIPTION, 'coalesce(e.local_name, r.ruled, n.column_name)', 'n.column_name')})
    description
from raw_names n left join exception_texts e on e.column_name = n.column_name
left join (select column_name, string_agg(coalesce(t.text, w.token), ' ' order by pos) ruled from (
    select column_name, unnest(string_split(column_name, '_')) token,
      generate_subscripts(string_split(column_name, '_'), 1) pos from raw_names) w
  left join token_texts t on t.token = w.token
  where not regexp_full_match(w.token, '[0-9]+') and coalesce(t.text, w.token) <> '' group by column_name) r
  on r.column_name = n.column_name""",
)


def _ruled(i: Inputs) -> DataFrame:
    return cat.rule_based_names(
        i.sql(_NAMES, "part", "customer"), i.sql(_TOKENS, "part", "customer"), i.sql(_EXCEPTIONS, "customer")
    )


@query("rule_based_names", "select * from ruled_names")
def _(i: Inputs) -> DataFrame:
    return _ruled(i)


# A schema as data: every part brand is a table with the names above as columns.
_SCHEMA = """select distinct p_brand table_id,
  concat(replace(p_name, ' ', '_'), '_', cast(p_size as string), '_', lower(p_type)) column_name,
  case when p_size % 2 = 0 then 'DOUBLE' else 'VARCHAR' end data_type, 1 ordinal from part"""
_DECLARED = """select distinct p_brand table_id,
  concat(replace(p_name, ' ', '_'), '_', cast(p_size as string), '_', lower(p_type)) column_name,
  'INTEGER' declared_type from part where p_size > 25"""
cte("schema_rows", _SCHEMA)
cte("declared_rows", _DECLARED)
cte(
    "built_catalog",
    f"""select concat(s.table_id, '.', s.column_name) column_id, s.table_id, s.column_name,
  coalesce(d.declared_type, s.data_type) data_type, concat(n.local_name, {quoted(M.DESCRIPTION_SEPARATOR)}, n.description)
    description, s.data_type actual_type, d.declared_type is not null overridden
from schema_rows s join ruled_names n on n.column_name = s.column_name
left join declared_rows d on d.table_id = s.table_id and d.column_name = s.column_name""",
)


def _built(i: Inputs) -> DataFrame:
    return cat.catalog_build(i.sql(_SCHEMA, "part"), _ruled(i), i.sql(_DECLARED, "part"))


@query("catalog_build", "select * from built_catalog")
def _(i: Inputs) -> DataFrame:
    return _built(i).drop("tag", "confidence", "updated_at")


@query(
    "override_log",
    "select table_id, column_name, actual_type, data_type declared_type from built_catalog where overridden",
)
def _(i: Inputs) -> DataFrame:
    return cat.override_log(_built(i))


@query(
    "relationship_build",
    """select concat('rel_Brand#1__', table_id) relationship_id, 'Brand#1' from_table_id, table_id to_table_id,
  'p_name' join_key, '1:N' relation_type, 'manual' source from (select distinct table_id from schema_rows) t
where table_id <> 'Brand#1'""",
)
def _(i: Inputs) -> DataFrame:
    all_tables = i.sql(_SCHEMA, "part").select("table_id").distinct()
    return cat.relationship_build(all_tables, "Brand#1", "p_name").drop("confidence")


@query(
    "table_catalog",
    f"select table_id, table_id table_name, 'given' source_system, row_count, "
    f"{printf(M.TABLE_DESCRIPTION, 'table_id')} description from row_counts",
)
def _(i: Inputs) -> DataFrame:
    return cat.table_catalog(tables.row_counts(i.tables(TABLES)), "given").drop("registered_at")


_EXPECTED = [("tables", "14"), ("columns", "64"), ("blank_descriptions", "0"), ("missing_types", "0"),
             ("vectors", "500"), ("relationships", "5")]
_EXPECTED_TYPES = [("lineitem.l_discount", "INTEGER"), ("orders.o_totalprice", "DOUBLE"), ("orders.gone", "DATE")]


@query(
    "quality_checks",
    f"""select e.check_name, e.expected, a.actual, e.expected is not distinct from a.actual passed from (
  {values(_EXPECTED, 'check_name, expected')}) e left join (
  select 'tables' check_name, cast(count(*) as varchar) actual from row_counts
  union all select 'columns', cast(count(*) as varchar) from column_spec
  union all select 'blank_descriptions', cast(count(*) as varchar) from column_spec where coalesce(description, '') = ''
  union all select 'missing_types', cast(count(*) as varchar) from column_spec where data_type is null
  union all select 'vectors', cast(count(*) as varchar) from embeddings
  union all select 'relationships', cast(count(*) as varchar) from relationships) a on a.check_name = e.check_name
union all select concat('type:', t.column_id), t.data_type, c.data_type, t.data_type is not distinct from c.data_type
from ({values(_EXPECTED_TYPES, 'column_id, data_type')}) t left join column_spec c on c.column_id = t.column_id""",
)
def _(i: Inputs) -> DataFrame:
    spark = i.spark
    return cat.quality_checks(
        tables.row_counts(i.tables(TABLES)),
        column_spec(i),
        i["embeddings"],
        i["relationships"],
        tables.small_table(spark, _EXPECTED, "check_name string, expected string"),
        tables.small_table(spark, _EXPECTED_TYPES, "column_id string, data_type string"),
    )


@query(
    "sample_rows",
    """select column_id, description, not contains(description, '|') polished from meta_columns
order by md5(concat('7:', column_id)), column_id limit 3""",
)
def _(i: Inputs) -> DataFrame:
    return cat.sample_rows(i["meta_columns"], 3, seed=7)


# --- glossary -----------------------------------------------------------------------

cte(
    "seeded",
    """select concat('term_', column_id) term_id, head canonical_term,
  array_to_string(list_sort(list_distinct([column_name, head])), ',') synonyms, description,
  column_id linked_column_id from (
  select *, case when contains(description, ' | ') then split_part(description, ' | ', 1) else column_name end head
  from (select column_id, table_id column_name, data_type, case when length(column_id) % 2 = 0 then description
    else column_name end description from meta_columns) m) h""",
)
_SEED_CATALOG = """select column_id, table_id column_name, data_type,
  case when length(column_id) % 2 = 0 then description else column_name end description from meta_columns"""
_OLD_TERMS = "select term_id from draft_terms where source = 'manual'"


@query(
    "glossary_seed",
    f"select *, 'draft' source from seeded where term_id not in ({_OLD_TERMS})",
)
def _(i: Inputs) -> DataFrame:
    seeds = G.glossary_seed(i.sql(_SEED_CATALOG, "meta_columns"), i.sql(_OLD_TERMS, "draft_terms"))
    return seeds.withColumn("synonyms", F.array_join("synonyms", ",")).drop("domain", "updated_at")


def _batches_sql(rows: str, key: str, size: int, digits: int) -> str:
    return f"""select batch_no, count(*) n, string_agg({key}, ',' order by no) keys from (
  select *, (no - 1) // {size} batch_no from (
    select *, row_number() over (order by substr(md5({key}), 1, {digits}), {key}) no from {rows}) b) x group by batch_no"""


def _unpacked(batches: DataFrame, key: str) -> DataFrame:
    """Reads the payloads back, so that the check covers their content."""
    records = F.from_json("payload", f"array<struct<{key}: string>>")
    return batches.select("batch_no", "n", F.array_join(F.transform(records, lambda r: r[key]), ",").alias("keys"))


@query("batch_pack", _batches_sql("draft_terms", "term_id", M.BATCH_SYNONYMS, 1))
def _(i: Inputs) -> DataFrame:
    packed = G.batch_pack(
        i["draft_terms"], "term_id", ["term_id", "canonical_term", "syn1", "description"], M.BATCH_SYNONYMS
    )
    return _unpacked(packed, "term_id")


@query(
    "batch_pack_orders",
    _batches_sql("(select cast(o_orderkey as varchar) k from orders) o", "k", M.BATCH_EMBEDDINGS, 2),
)
def _(i: Inputs) -> DataFrame:
    rows = i["orders"].select(F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority")
    return _unpacked(G.batch_pack(rows, "k", ["k", "o_orderpriority"], M.BATCH_EMBEDDINGS, 2), "k")


# Replies: one array of one item per catalog column and brand; some name no known term.
_SUGGESTED = """select concat(case when length(table_id) % 2 = 0 then concat('```json', chr(10)) else '' end,
  '[{"term_id":"', case when length(column_id) % 5 = 0 then 'gone' else concat('term_', column_id) end,
  '","additional_synonyms":["', data_type, '","', table_id, '"],"domain":"', data_type, '"}]',
  case when length(table_id) % 2 = 0 then concat(chr(10), '```') else '' end) response from meta_columns"""


def _terms(i: Inputs) -> DataFrame:
    return i["draft_terms"].withColumn("synonyms", F.array("syn1", "syn2"))


cte(
    "merged_terms",
    """select t.term_id, canonical_term, concat(syn1, ',', syn2) original_synonyms,
  array_to_string(list_sort(list_distinct([syn1, syn2, data_type, table_id])), ',') suggested_synonyms,
  data_type "domain", linked_column_id
from meta_columns m join draft_terms t on t.term_id = concat('term_', m.column_id) where length(m.column_id) % 5 <> 0""",
)


def _merged(i: Inputs) -> DataFrame:
    return G.synonym_merge(_terms(i), i.sql(_SUGGESTED, "meta_columns"))


@query("synonym_merge", "select * from merged_terms")
def _(i: Inputs) -> DataFrame:
    rows = _merged(i)
    for c in ("original_synonyms", "suggested_synonyms"):
        rows = rows.withColumn(c, F.array_join(c, ","))
    return rows


@query("review_sink", "select *, null approve from merged_terms")
def _(i: Inputs) -> DataFrame:
    path = sinks.review_sink(_merged(i), scratch(i, "review"))
    return sheets.read_csv_with_header(i.spark, path)


@query(
    "unreadable_replies",
    """select case when o_orderkey % 3 = 0 then 'no list' else concat('{"term_id":"', o_orderpriority, '"}') end response
from orders where o_orderkey % 3 <> 1""",
)
def _(i: Inputs) -> DataFrame:
    reply = F.when(F.col("o_orderkey") % 3 == 0, F.lit("no list")).when(F.col("o_orderkey") % 3 == 1, F.lit("```\n[]\n```"))
    other = F.concat(F.lit('{"term_id":"'), "o_orderpriority", F.lit('"}'))
    return G.unreadable_replies(i["orders"].select(reply.otherwise(other).alias("response")))


@query(
    "review_file",
    """select t.term_id, case when ok then suggested_synonyms else concat(syn1, ',', syn2) end synonyms,
  case when ok then m."domain" end "domain", case when ok then 'llm_generated_reviewed' else t.source end source
from draft_terms t left join (select *, length(term_id) % 2 = 0 ok from merged_terms) m on m.term_id = t.term_id""",
)
def _(i: Inputs) -> DataFrame:
    """A review file written, approved in part, read back and applied."""
    drafts = sinks.review_rows(_merged(i))
    approved = drafts.withColumn("approve", F.when(F.length("term_id") % 2 == 0, F.lit("y")).otherwise(F.lit("n")))
    path = scratch(i, "approved")
    approved.write.csv(path, header=True, emptyValue="")
    terms = _terms(i).withColumn("domain", F.lit(None).cast("string"))
    done = G.review_apply(terms, sheets.read_review(i.spark, path))
    return done.select("term_id", F.array_join("synonyms", ",").alias("synonyms"), "domain", "source")


_REVIEW = """select concat('term_', column_id) term_id, {array}(table_id, data_type) suggested_synonyms,
  case when length(table_id) % 2 = 0 then '' else data_type end domain,
  case length(column_name) % 4 when 0 then 'y' when 1 then ' Y ' when 2 then 'n' else null end approve, 1 line
from meta_columns"""


@query(
    "review_apply",
    f"""select t.term_id, case when ok then array_to_string(s, ',') else concat(syn1, ',', syn2) end synonyms,
  case when ok then nullif(d, '') end "domain", case when ok then 'llm_generated_reviewed' else t.source end source
from draft_terms t left join (select term_id id, suggested_synonyms s, domain d,
  coalesce(lower(trim(approve)) = 'y', false) ok from ({_REVIEW.replace('{array}', 'list_value')}) r) r on r.id = t.term_id""",
)
def _(i: Inputs) -> DataFrame:
    terms = _terms(i).withColumn("domain", F.lit(None).cast("string"))
    review = i.sql(_REVIEW.replace("{array}", "array"), "meta_columns")
    done = G.review_apply(terms, review)
    return done.select("term_id", F.array_join("synonyms", ",").alias("synonyms"), "domain", "source")


@query(
    "review_counts",
    f"""select sum(case when lower(trim(approve)) = 'y' then 1 else 0 end)::bigint approved,
  sum(case when lower(trim(approve)) = 'y' then 0 else 1 end)::bigint skipped
from ({_REVIEW.replace('{array}', 'list_value')}) r""",
)
def _(i: Inputs) -> DataFrame:
    return G.review_counts(i.sql(_REVIEW.replace("{array}", "array"), "meta_columns"))


@query(
    "polish_requests",
    """select column_id, case when contains(description, ' | ') then split_part(description, ' | ', 1) else '' end local_name,
  case when contains(description, ' | ') then substr(description, strpos(description, ' | ') + 3) else description end
    raw_description from built_catalog""",
)
def _(i: Inputs) -> DataFrame:
    return G.polish_requests(_built(i))


_POLISHED = """select column_id, concat('A ', data_type, ' of ', table_id) description from meta_columns
where data_type <> 'VARCHAR'"""


@query(
    "description_upsert",
    f"""select m.column_id, coalesce(p.description, m.description) description
from meta_columns m left join ({_POLISHED}) p on p.column_id = m.column_id""",
)
def _(i: Inputs) -> DataFrame:
    done = G.description_upsert(i["meta_columns"], i.sql(_POLISHED, "meta_columns"))
    return done.select("column_id", "description")


@query(
    "embedding_text",
    """select term_id key, trim(concat(canonical_term, ' ', syn1, ',', syn2, ' ', coalesce(description, ''))) text
from draft_terms where source in ('llm_generated_reviewed', 'manual')
union all select column_id, description from meta_columns""",
)
def _(i: Inputs) -> DataFrame:
    terms = G.glossary_texts(_terms(i)).select(F.col("term_id").alias("key"), "text")
    return terms.unionByName(G.column_texts(i["meta_columns"]).select(F.col("column_id").alias("key"), "text"))


@query(
    "rebuild_vectors",
    "select column_id, len(embedding) dim, md5(array_to_string(list_transform(embedding, lambda x: "
    "cast(cast(round(x * 1e6) as bigint) as varchar)), ',')) digest from vec_columns",
)
def _(i: Inputs) -> DataFrame:
    columns = i["vec_columns"]
    vectors = G.rebuild_vectors(G.column_texts(columns), columns, "column_id")
    parts = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string"))
    return vectors.select(
        "column_id",
        F.size("embedding").cast("long").alias("dim"),
        F.md5(F.array_join(parts, ",").cast("binary")).alias("digest"),
    )


# --- event log ----------------------------------------------------------------------

cte(
    "sequenced",
    """select thread_id, event_id, ts, node, seq, round(
  (epoch_us(ts) - epoch_us(coalesce(prev, date_trunc('day', first_ts)))) / 1e6, 2) elapsed_sec from (
  select *, row_number() over w - 1 seq, lag(ts) over w prev, min(ts) over (partition by thread_id) first_ts
  from pipeline_events window w as (partition by thread_id order by ts, event_id)) x""",
)


def _starts(events: DataFrame) -> DataFrame:
    return events.groupBy("thread_id").agg(F.date_trunc("day", F.min("ts")).alias("started_at"))


def _sequenced(i: Inputs) -> DataFrame:
    log = i["pipeline_events"]
    return ev.event_sequence(log, _starts(log))


@query("event_sequence", "select thread_id, event_id, node, seq, elapsed_sec from sequenced")
def _(i: Inputs) -> DataFrame:
    return _sequenced(i).select("thread_id", "event_id", "node", "seq", "elapsed_sec")


_STATES = {"view": "running", "click": "running", "signup": "waiting_human", "purchase": "done", "error": "error"}
_STATUS = f"""select thread_id, status from (select thread_id, {case_of('node', _STATES)} status,
  row_number() over (partition by thread_id order by ts desc, event_id desc) k from pipeline_events) x where k = 1"""
_POLLS = "select user_id thread_id, count(*) - user_id % 4 since from events group by user_id"


def _states(i: Inputs) -> DataFrame:
    states = F.create_map(*[F.lit(x) for pair in _STATES.items() for x in pair])
    return i["pipeline_events"].withColumn("status", F.try_element_at(states, F.col("node")))


@query(
    "events_since",
    f"""select p.thread_id, event_id, seq, n next_since, status from ({_POLLS}) p
join (select thread_id t, count(*) n from pipeline_events group by 1) c on c.t = p.thread_id
join ({_STATUS}) r on r.thread_id = p.thread_id
left join sequenced s on s.thread_id = p.thread_id and seq >= since""",
)
def _(i: Inputs) -> DataFrame:
    """Every fourth run is polled when it has nothing new."""
    log = i["pipeline_events"]
    totals = log.groupBy("thread_id").agg(F.count("*").alias("n"))
    polls = totals.select("thread_id", (F.col("n") - F.col("thread_id") % 4).alias("since"))
    found = ev.events_since(_sequenced(i), polls, _states(i), totals)
    return found.select("thread_id", "event_id", "seq", "next_since", "status")


@query("run_status", _STATUS)
def _(i: Inputs) -> DataFrame:
    return ev.run_status(_states(i)).select("thread_id", "status")


_RECORDS = """select concat('c', cast(user_id as string)) column_id, concat(event_type, '?') question,
  case when event_id % 3 = 0 then 'approved' else 'rejected' end answer from events"""
_HISTORY = """select concat('c', cast(user_id as string)) column_id, concat(event_type, '?') question, 'approved' answer
from events where value > 100"""


@query("audit_dedupe", f"select * from ({_RECORDS}) r except select * from ({_HISTORY}) h")
def _(i: Inputs) -> DataFrame:
    return ev.audit_dedupe(i.sql(_RECORDS, "events"), i.sql(_HISTORY, "events"))


_NODES = """select case event_type when 'view' then 'parsing' when 'click' then 'meta_judge' when 'signup' then
  'meta_exact_check' when 'purchase' then 'meta_retry' else 'other' end node, event_id,
  case event_type when 'signup' then case event_id % 3 when 0 then 'true' when 1 then 'false' else 'empty' end
    else cast(event_id as string) end detail, event_type detail2 from events"""


@query(
    "node_metadata",
    f"""select event_id, node, coalesce({case_of('node', M.NODE_LABELS)}, node) label, node tool,
  case node when 'parsing' then {printf(M.NODE_SUMMARIES['parsing'], 'detail')}
    when 'meta_judge' then {printf(M.NODE_SUMMARIES['meta_judge'], 'detail', 'detail2')}
    when 'meta_retry' then {printf(M.NODE_SUMMARIES['meta_retry'], 'detail')}
    when 'meta_exact_check' then {case_of('detail', M.EXACT_CHECK_SUMMARIES)}
    else {quoted(M.DEFAULT_SUMMARY)} end summary
from ({_NODES}) n""",
)
def _(i: Inputs) -> DataFrame:
    log = ev.node_metadata(i.sql(_NODES, "events"), ev.node_dictionary(i.spark))
    return ev.node_summary(log).select("event_id", "node", "label", "tool", "summary")


_PARTS = 3  # arrivals of a followed log


def _arrivals(rows: DataFrame, order: str) -> list[DataFrame]:
    """A table in parts of later and later rows."""
    first, last = rows.agg(F.min(order), F.max(order)).first()
    step = (last - first) / _PARTS
    bounds = [first + step * k for k in range(1, _PARTS)]
    part = F.lit(0)
    for bound in bounds:
        part = part + (F.col(order) > F.lit(bound)).cast("int")
    return [rows.where(part == k) for k in range(_PARTS)]


@query(
    "follow_events",
    "select thread_id, event_id, seq, case when seq > 0 then elapsed_sec end elapsed_sec from sequenced",
)
def _(i: Inputs) -> DataFrame:
    """The event log followed as it arrives in three parts; the last batch is run twice."""
    folder = scratch(i, "followed")
    log = i["pipeline_events"].select("thread_id", "event_id", "ts", "node")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    parts = _arrivals(log, "ts")
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        new = streams.read_log(i.spark, f"{folder}/in", schema)
        streams.follow_events(new, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    streams.event_step(log, f"{folder}/out")(parts[-1], _PARTS - 1)
    return i.spark.read.parquet(f"{folder}/out/events").select("thread_id", "event_id", "seq", "elapsed_sec")


@query("follow_audit", f"select distinct * from ({_RECORDS}) r")
def _(i: Inputs) -> DataFrame:
    """Audit records followed as they arrive in three parts; the first one arrives again."""
    folder = scratch(i, "audit")
    records = i.sql(f"select r.*, cast(substr(column_id, 2) as bigint) n from ({_RECORDS}) r", "events")
    parts = [p.drop("n") for p in _arrivals(records, "n")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts[0].schema)
    for part in (*parts, parts[0]):
        part.write.mode("append").parquet(f"{folder}/in")
        new = streams.read_log(i.spark, f"{folder}/in", schema)
        streams.follow_audit(new, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return streams.audit_history(i.spark, f"{folder}/out", parts[0])


@query(
    "review_apply_stored",
    f"""select t.term_id, case when ok then array_to_string(s, ',') else concat(syn1, ',', syn2) end synonyms,
  case when ok then nullif(d, '') end "domain", case when ok then 'llm_generated_reviewed' else t.source end source
from draft_terms t left join (select term_id id, suggested_synonyms s, domain d,
  coalesce(lower(trim(approve)) = 'y', false) ok from ({_REVIEW.replace('{array}', 'list_value')}) r) r on r.id = t.term_id""",
)
def _(i: Inputs) -> DataFrame:
    """A stored glossary changed in place, by a review that is applied twice."""
    path = scratch(i, "glossary")
    terms = _terms(i).withColumn("domain", F.lit(None).cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in terms.schema)
    buckets.write_buckets(terms, path, catalogs.TERM)
    review = i.sql(_REVIEW.replace("{array}", "array"), "meta_columns")
    for _ in range(2):
        catalogs.store_reviews(review, path, schema)
    done = buckets.read_buckets(i.spark, path, schema)
    return done.select("term_id", F.array_join("synonyms", ",").alias("synonyms"), "domain", "source")


@query(
    "description_upsert_stored",
    f"""select m.column_id, coalesce(p.description, m.description) description
from meta_columns m left join ({_POLISHED}) p on p.column_id = m.column_id""",
)
def _(i: Inputs) -> DataFrame:
    """A stored catalog whose descriptions are changed in place."""
    path = scratch(i, "catalog")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in i["meta_columns"].schema)
    buckets.write_buckets(i["meta_columns"], path, catalogs.COLUMN)
    catalogs.store_descriptions(i.sql(_POLISHED, "meta_columns"), path, schema)
    return buckets.read_buckets(i.spark, path, schema).select("column_id", "description")
