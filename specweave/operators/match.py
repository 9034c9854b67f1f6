"""Exact matching, candidate merging, relations and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import strip

META = ["column_id", "table_id", "column_name", "data_type", "description"]
SOURCES = ["vss_column", "vss_glossary", "fuzzy"]  # earlier wins a tie


def exact_match(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join on the trimmed English name (case-sensitive).

    Adds match_column_id, match_table_id, ... of the lowest (table_id, column_id) and
    ``n_matches``, 0 where the name is unknown.
    """
    first = catalog.groupBy(F.col("column_name").alias("wanted")).agg(
        F.min(F.struct("table_id", "column_id", "column_name", "data_type", "description")).alias("m"),
        F.count("*").alias("n"),
    )
    joined = rows.withColumn("wanted", strip(F.col("eng_name"))).join(first, "wanted", "left")
    return joined.select(
        *rows.columns,
        *[F.col(f"m.{c}").alias(f"match_{c}") for c in META],
        F.coalesce("n", F.lit(0)).alias("n_matches"),
    )


def column_lookup(rows: DataFrame, catalog: DataFrame, key: str = "column_id") -> DataFrame:
    """Adds the catalog row of ``key`` as meta_*; null where it is unknown."""
    meta = catalog.select(
        F.col("column_id").alias(key), *[F.col(c).alias(f"meta_{c}") for c in META[1:]]
    )
    return rows.join(meta, key, "left")


def widest() -> dict:
    """Search width that serves every attempt at once."""
    return M.search_params(M.MAX_RETRIES)


def attempts_table() -> F.Column:
    """Array of the search parameters of all attempts."""
    return F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in M.search_params(a).items()])
            for a in range(M.MAX_RETRIES + 1)
        ]
    )


def candidate_merge(hits: DataFrame, key: str = "ask_id") -> DataFrame:
    """Candidates per (key, attempt) from the hits of all three sources.

    hits(key, column_id, source, score, place): ``place`` is the rank within its own
    search.  An attempt sees a hit when it lies within its limit and floor.  Per column
    the best vector hit stays (earlier source on equal scores at four decimals); a string
    hit counts only without one.  -> (key, attempt, column_id, source, score, rank).
    """
    string = F.col("source") == "fuzzy"
    order = F.array_position(F.lit(SOURCES), F.col("source")).cast("int")
    seen = (
        hits.withColumn("a", F.explode(attempts_table()))
        .where(
            F.when(string, (F.col("place") <= F.col("a.top_k")) & (F.col("score") >= F.col("a.string_cut")))
            .otherwise((F.col("place") <= F.col("a.vector_limit")) & (F.col("score") >= F.col("a.floor")))
        )
        .select(
            key, "a.attempt", "a.top_k", "column_id",
            F.struct(
                string.alias("is_string"),
                (-F.round("score", 4)).alias("minus"),
                order.alias("source_no"),
                "source",
            ).alias("hit"),
        )
    )
    kept = seen.groupBy(key, "attempt", "top_k", "column_id").agg(F.min("hit").alias("hit"))
    ranked = Window.partitionBy(key, "attempt").orderBy("hit.minus", "hit.source_no", "column_id")
    return (
        kept.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= F.col("top_k"))
        .select(
            key, "attempt", "column_id", F.col("hit.source").alias("source"),
            (-F.col("hit.minus")).alias("score"), "rank",
        )
    )


def relations_of(table_ids: DataFrame, relationships: DataFrame) -> DataFrame:
    """(table_id, from_table_id, to_table_id, join_key, relation_type) for either side.

    Two equi-joins instead of one OR-join; a relation of a table with itself counts once.
    """
    fields = ["from_table_id", "to_table_id", "join_key", "relation_type"]
    wanted = table_ids.select("table_id").where("table_id is not null").distinct()
    outgoing = relationships.select(F.col("from_table_id").alias("table_id"), *fields)
    incoming = relationships.where("not (from_table_id <=> to_table_id)").select(
        F.col("to_table_id").alias("table_id"), *fields
    )
    return outgoing.unionByName(incoming).join(wanted, "table_id", "left_semi")


def relationship_counts(rows: DataFrame, relationships: DataFrame, key: str = "table_id") -> DataFrame:
    """Adds ``n_relationships`` of the row's table.

    For wide dimensions keep the relations themselves in a table of their own
    (``relations_of``) and join it where it is read: a table with very many relations is
    then neither gathered in one place nor copied into every row.
    """
    related = relations_of(rows.select(F.col(key).alias("table_id")), relationships)
    counts = related.groupBy(F.col("table_id").alias(key)).agg(F.count("*").alias("n_relationships"))
    return rows.join(counts, key, "left").withColumn(
        "n_relationships", F.coalesce("n_relationships", F.lit(0))
    )


def relationship_enrich(rows: DataFrame, relationships: DataFrame, key: str = "table_id") -> DataFrame:
    """Adds ``table_relationships``, the list of relations of the row's table (or empty).

    The list is built once per table, but every row carries a copy: meant for catalogs
    whose tables have a handful of relations each.
    """
    related = relations_of(rows.select(F.col(key).alias("table_id")), relationships)
    relation = F.struct(
        F.col("from_table_id").alias("source_table"),
        F.col("to_table_id").alias("target_table"),
        "join_key",
        "relation_type",
    )
    lists = related.groupBy(F.col("table_id").alias(key)).agg(
        F.sort_array(F.collect_list(relation)).alias("table_relationships")
    )
    joined = rows.join(lists, key, "left")
    kind = joined.schema["table_relationships"].dataType
    return joined.withColumn(
        "table_relationships", F.coalesce("table_relationships", F.array().cast(kind))
    )


def selected_candidate(judged: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Adds chosen_column_id: the judged column when it is a candidate, else the first one."""
    best = candidates.groupBy(*keys).agg(
        F.min_by("column_id", "rank").alias("first_id"),
        F.collect_set("column_id").alias("ids"),  # at most top_k
    )
    inside = F.array_contains("ids", F.col("selected_column_id"))
    return (
        judged.join(best, keys, "left")
        .withColumn("chosen_column_id", F.when(inside, F.col("selected_column_id")).otherwise(F.col("first_id")))
        .drop("first_id", "ids")
    )
