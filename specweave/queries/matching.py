"""Queries over exact, string and vector matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import evaluate, match, strings, vectors
from specweave.operators.match import widest
from specweave.queries.inputs import Inputs
from specweave.queries.oracle import cosine, cte, exact_cte, ratio, token_sorted
from specweave.queries.registry import query
from specweave.session import shared

cte("matched_specs", exact_cte("spec_rows", "meta_columns"))


@query(
    "exact_match",
    "select spec_id, row_idx, column_id match_column_id, table_id match_table_id, data_type match_data_type, "
    "n_matches from matched_specs",
)
def _(i: Inputs) -> DataFrame:
    found = match.exact_match(i["spec_rows"], i["meta_columns"])
    return found.select(
        "spec_id", "row_idx", "match_column_id", "match_table_id", "match_data_type", "n_matches"
    )


_PAIRS = "select distinct eng_name, description from spec_rows"


@query(
    "token_sort_similarity",
    f"""select eng_name, description, round({ratio('a', 'b')}, 4) similarity from (
  select *, {token_sorted('eng_name')} a, {token_sorted('description')} b from ({_PAIRS}) p) x""",
)
def _(i: Inputs) -> DataFrame:
    pairs = i.sql(_PAIRS, "spec_rows")
    score = strings.token_sort_similarity(F.col("eng_name"), F.col("description"))
    return pairs.withColumn("similarity", score)


def fuzzy_sql(names: str, catalog: str, k: int, cut: float) -> str:
    """Top-k columns per distinct name by brute force."""
    return f"""select eng_name, column_id, round(score, 4) score, string_rank from (
  select n.eng_name, c.column_id, s.score,
    row_number() over (partition by n.eng_name order by s.score desc, c.column_id) string_rank
  from (select eng_name, {token_sorted('eng_name')} form from (select distinct trim(eng_name) eng_name from {names}) d) n
  join (select a, b, {ratio('a', 'b')} score from
    (select distinct {token_sorted('eng_name')} a from {names}) qa,
    (select distinct {token_sorted('column_name')} b from {catalog}) qb) s on s.a = n.form and s.score >= {cut}
  join (select column_id, {token_sorted('column_name')} form from {catalog}) c on c.form = s.b) r
  where string_rank <= {k}"""


@query("fuzzy_topk", fuzzy_sql("spec_rows", "meta_columns", M.BASE_TOP_K, M.STRING_CUT))
def _(i: Inputs) -> DataFrame:
    names = i["spec_rows"].select(F.trim("eng_name").alias("eng_name"))
    found = strings.fuzzy_topk(names, i["meta_columns"], keep=shared)
    return found.withColumn("string_rank", F.col("string_rank").cast("long"))


@query("fuzzy_topk_urls")
def _(i: Inputs) -> DataFrame:
    """Every url against every customer name and longer url: long, many and whole texts."""
    urls = i["pages"].select(F.col("url").alias("eng_name"))
    names = i["customer"].select(F.col("c_name").alias("column_name")).unionByName(
        i["pages"].select(F.concat(F.col("url"), F.lit("/x")).alias("column_name"))
    )
    catalog = names.distinct().withColumn("column_id", F.md5("column_name"))
    return strings.fuzzy_topk(urls, catalog, keep=shared)


_FLOOR, _LIMIT = 0.25, 10


def nearest_sql(queries: str, entries: str, limit: int, floor: float | None) -> str:
    """queries(query_id, q), entries(entry_id, e)."""
    keep = "" if floor is None else f"where similarity >= {floor}"
    return f"""select query_id, entry_id, similarity, vector_rank from (
  select *, row_number() over (partition by query_id order by similarity desc, entry_id) vector_rank from (
    select query_id, entry_id, {cosine('q', 'e')} similarity from {queries}, {entries}) p {keep}) r
  where vector_rank <= {limit}"""


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("similarity", F.round("similarity", 4)).withColumn(
        "vector_rank", F.col("vector_rank").cast("long")
    )


_QUERIES = "(select cast(vec_id as varchar) query_id, embedding q from embeddings) qs"


@query(
    "vector_topk_columns",
    "select query_id, entry_id column_id, round(similarity, 4) similarity, vector_rank from ("
    + nearest_sql(_QUERIES, "(select column_id entry_id, embedding e from vec_columns) es", _LIMIT, _FLOOR)
    + ") t",
)
def _(i: Inputs) -> DataFrame:
    columns = i["vec_columns"]
    queries = i["embeddings"].select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return rounded(
        vectors.vector_topk_columns(
            queries, columns.select("column_id", "embedding"), columns, _LIMIT, _FLOOR
        )
    )


@query(
    "vector_topk_glossary",
    "select query_id, term_id, linked_column_id column_id, round(similarity, 4) similarity, vector_rank from ("
    + nearest_sql(
        _QUERIES,
        "(select term_id entry_id, embedding e from vec_terms where linked_column_id is not null) es",
        _LIMIT, _FLOOR,
    )
    + ") t join vec_terms on term_id = entry_id where linked_column_id in (select column_id from vec_columns)",
)
def _(i: Inputs) -> DataFrame:
    terms = i["vec_terms"]
    queries = i["embeddings"].select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return rounded(
        vectors.vector_topk_glossary(
            queries, terms.select("term_id", "embedding"), terms, i["vec_columns"], _LIMIT, _FLOOR
        )
    )


@query(
    "self_similarity_check",
    """select query_id entry_id, count(*) n_neighbours, round(1 - max(similarity), 4) own_distance,
  round(1 - max(similarity), 4) = 0 passed, max(case when vector_rank = 1 then entry_id end) first_id from ("""
    + nearest_sql(_QUERIES, "(select cast(vec_id as varchar) entry_id, embedding e from embeddings) es", 3, None)
    + ") t group by query_id",
)
def _(i: Inputs) -> DataFrame:
    stored = i["embeddings"].select(F.col("vec_id").cast("string").alias("entry_id"), "embedding")
    return vectors.self_similarity_check(stored)


# --- candidates of the vector world -------------------------------------------------

_WIDE = widest()
cte(
    "ask_vectors",
    "select ask_id query_id, list_transform(list_zip(va, vb), "
    "lambda p: cast(p[1] as double) + share * cast(p[2] as double)) q from vec_asks",
)
cte(
    "ask_hits",
    f"""select query_id ask_id, entry_id column_id, 'vss_column' source, 1 source_no, similarity score, vector_rank place
  from ({nearest_sql('ask_vectors', '(select column_id entry_id, embedding e from vec_columns) es',
                     _WIDE['vector_limit'], _WIDE['floor'])}) a
union all
select query_id, linked_column_id, 'vss_glossary', 2, similarity, vector_rank from (
  {nearest_sql('ask_vectors',
               '(select term_id entry_id, embedding e from vec_terms where linked_column_id is not null) es',
               _WIDE['vector_limit'], _WIDE['floor'])}) b
  join vec_terms on term_id = entry_id where linked_column_id in (select column_id from vec_columns)
union all
select ask_id, column_id, 'fuzzy', 3, score, string_rank
  from ({fuzzy_sql('vec_asks', 'vec_columns', _WIDE['top_k'], _WIDE['string_cut'])}) f
  join vec_asks a on a.eng_name = f.eng_name""",
)
cte(
    "attempts",
    "\nunion all ".join(
        f"select {p['attempt']} attempt, {p['top_k']} top_k, {p['floor']} low, {p['vector_limit']} vector_limit, "
        f"{p['string_cut']} string_cut"
        for p in (M.search_params(a) for a in range(M.MAX_RETRIES + 1))
    ),
)
def merged_sql(hits: str) -> str:
    """hits(ask_id, column_id, source, source_no, score, place) to candidates per attempt."""
    return f"""select ask_id, attempt, column_id, source, score, rank from (
  select *, row_number() over (partition by ask_id, attempt order by score desc, source_no, column_id) rank from (
    select *, row_number() over (partition by ask_id, attempt, column_id
      order by source = 'fuzzy', score desc, source_no) one from (
      select ask_id, column_id, source, source_no, round(score, 4) score, attempt, top_k
      from {hits}, attempts
      where (source = 'fuzzy' and place <= top_k and score >= string_cut)
         or (source <> 'fuzzy' and place <= vector_limit and score >= low)) h) k where one = 1) r
  where rank <= top_k"""


cte("ask_candidates", merged_sql("ask_hits"))


def ask_candidates(i: Inputs) -> DataFrame:
    """Candidates of every ask at every attempt: three searches, one merge."""
    asks = i["vec_asks"]
    columns, terms = i["vec_columns"], i["vec_terms"]
    mixed = F.zip_with(
        "va", "vb", lambda a, b: a.cast("double") + F.col("share") * b.cast("double")
    )
    queries = asks.select(F.col("ask_id").alias("query_id"), mixed.alias("embedding"))
    wide = widest()
    limit, floor = wide["vector_limit"], wide["floor"]
    by_column = vectors.vector_topk_columns(
        queries, columns.select("column_id", "embedding"), columns, limit, floor
    )
    by_term = vectors.vector_topk_glossary(
        queries, terms.select("term_id", "embedding"), terms, columns, limit, floor
    )
    by_name = strings.fuzzy_topk(asks.select("eng_name"), columns, wide["top_k"], wide["string_cut"])

    def hits(found: DataFrame, key: str, source: str, score: str, place: str) -> DataFrame:
        return found.select(
            F.col(key).alias("ask_id"), "column_id", F.lit(source).alias("source"),
            F.col(score).alias("score"), F.col(place).alias("place"),
        )

    named = by_name.join(asks.select("ask_id", "eng_name"), "eng_name")
    return match.candidate_merge(
        hits(by_column, "query_id", "vss_column", "similarity", "vector_rank")
        .unionByName(hits(by_term, "query_id", "vss_glossary", "similarity", "vector_rank"))
        .unionByName(hits(named, "ask_id", "fuzzy", "score", "string_rank"))
    )


@query("candidate_merge", "select * from ask_candidates")
def _(i: Inputs) -> DataFrame:
    found = ask_candidates(i)
    return found.withColumn("rank", F.col("rank").cast("long"))


cte(
    "sided_relations",
    """select from_table_id table_id, * from relationships
union all select to_table_id, * from relationships where from_table_id <> to_table_id""",
)


@query(
    "relations_of",
    "select * from sided_relations where table_id in (select table_id from placed_rows)",
)
def _(i: Inputs) -> DataFrame:
    return match.relations_of(i["placed_rows"], i["relationships"])


@query(
    "relationship_counts",
    """select spec_id, row_idx, r.table_id, coalesce(n, 0) n_relationships from placed_rows r
left join (select table_id, count(*) n from sided_relations group by table_id) t on t.table_id = r.table_id""",
)
def _(i: Inputs) -> DataFrame:
    return match.relationship_counts(i["placed_rows"], i["relationships"])


# A star: every brand's tables belong to the brand's dimension, few relations each.
_STAR = """select distinct p_brand from_table_id, concat(p_brand, '/', p_type) to_table_id, 'p_name' join_key,
  '1:N' relation_type from part"""
_STAR_ROWS = """select cast(p_partkey as string) spec_id, p_partkey row_idx,
  case p_partkey % 3 when 0 then p_brand when 1 then concat(p_brand, '/', p_type) else p_name end table_id from part"""


@query(
    "relationship_enrich",
    f"""select spec_id, row_idx, r.table_id, coalesce(lines, '') relations from ({_STAR_ROWS}) r left join (
  select table_id, string_agg(line, ',' order by line) lines from (
    select from_table_id table_id, concat(from_table_id, '>', to_table_id) line from ({_STAR}) s
    union all select to_table_id, concat(from_table_id, '>', to_table_id) from ({_STAR}) t) b
  group by table_id) x on x.table_id = r.table_id""",
)
def _(i: Inputs) -> DataFrame:
    rows = match.relationship_enrich(i.sql(_STAR_ROWS, "part"), i.sql(_STAR, "part"))
    lines = F.transform(
        "table_relationships", lambda r: F.concat(r["source_table"], F.lit(">"), r["target_table"])
    )
    return rows.select("spec_id", "row_idx", "table_id", F.array_join(F.array_sort(lines), ",").alias("relations"))


_LOOKUPS = """select spec_id, row_idx, concat('Brand#', cast(row_idx % 30 as string), '.', trim(eng_name)) column_id
from spec_rows"""


@query(
    "column_lookup",
    f"""select spec_id, row_idx, l.column_id, c.table_id meta_table_id, c.column_name meta_column_name,
  c.data_type meta_data_type, c.description meta_description
from ({_LOOKUPS}) l left join meta_columns c on c.column_id = l.column_id""",
)
def _(i: Inputs) -> DataFrame:
    return match.column_lookup(i.sql(_LOOKUPS, "spec_rows"), i["meta_columns"])


_JUDGED = """select o_orderkey ask, case when o_orderkey % 3 = 0 then null
  else concat('p', cast(o_orderkey % 50 as string)) end selected_column_id from orders"""
_LISTED = """select l_orderkey ask, concat('p', cast(l_partkey % 50 as string)) column_id,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) rank
from lineitem"""


@query(
    "selected_candidate",
    f"""select j.ask, selected_column_id, coalesce(max(case when c.column_id = selected_column_id then c.column_id end),
  min_by(c.column_id, c.rank)) chosen_column_id
from ({_JUDGED}) j left join ({_LISTED}) c on c.ask = j.ask group by j.ask, selected_column_id""",
)
def _(i: Inputs) -> DataFrame:
    return match.selected_candidate(i.sql(_JUDGED, "orders"), i.sql(_LISTED, "lineitem"), ["ask"])


cte(
    "close_names",
    "select distinct eng_name from ("
    + fuzzy_sql(
        "(select * from spec_rows where trim(eng_name) not in (select column_name from meta_columns))",
        "meta_columns", M.EVAL_STRING_TOP_K, M.STRING_CUT,
    )
    + ") f",
)


@query(
    "eval_coverage",
    """select spec_id, count(*) n,
  round(avg(case when trim(eng_name) in (select column_name from meta_columns) then 1e0 else 0 end), 4) exact_hit_rate,
  round(avg(case when trim(eng_name) in (select eng_name from close_names) then 1e0 else 0 end), 4)
    fuzzy_additional_hit_rate
from spec_rows group by spec_id""",
)
def _(i: Inputs) -> DataFrame:
    return evaluate.eval_coverage(i["spec_rows"], i["meta_columns"], ["spec_id"])
