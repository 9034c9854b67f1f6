"""Glossary maintenance: seed, batches, synonyms, review and embedding texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.text import head_of, md5_bucket, strip, tail_of, unfenced
from specweave.operators.numbering import PLACE, RANGE, Keep, in_ranges, range_heads
from specweave.session import shared


def glossary_seed(catalog: DataFrame, terms: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Draft terms of the catalog columns that have none yet."""
    local = head_of(F.col("description"), F.col("column_name"))
    seeds = catalog.select(
        F.concat(F.lit("term_"), "column_id").alias("term_id"),
        local.alias("canonical_term"),
        F.array_sort(F.array_distinct(F.array("column_name", local))).alias("synonyms"),
        F.lit(None).cast("string").alias("domain"),
        "description",
        F.col("column_id").alias("linked_column_id"),
        F.lit("draft").alias("source"),
        (F.lit(None).cast("timestamp") if at is None else at).alias("updated_at"),
    )
    if terms is None:
        return seeds
    return seeds.join(terms.select("term_id"), "term_id", "left_anti")


def batch_pack(
    rows: DataFrame, key: str, fields: list[str], size: int, bucket_digits: int = 1, keep: Keep = shared
) -> DataFrame:
    """(batch_no, n, payload): JSON arrays of ``size`` rows; only the last one may be short.

    Rows come in the order of ``bucket_digits`` digits of the key's md5 and then of the key.  They are numbered
    by ranges of that order (``numbering``), so no window holds rows of the table.
    """
    columns = list(dict.fromkeys([key, *fields]))
    placed = in_ranges(rows.select(md5_bucket(F.col(key), bucket_digits).alias("_bucket"), *columns), ["_bucket", *columns], keep)
    heads = range_heads(placed.withColumn("_all", F.lit(0)), ["_all"]).select(RANGE, F.col("done").alias("_done"))
    record = F.struct(F.col("_no"), F.struct(*fields).alias("record"))
    return (
        placed.join(heads, RANGE)
        .withColumn("_no", F.col(PLACE) + F.col("_done"))
        .withColumn("batch_no", F.floor(F.col("_no") / size))
        .groupBy("batch_no")
        .agg(F.count("*").alias("n"), F.array_sort(F.collect_list(record)).alias("r"))
        .select(
            "batch_no", "n",
            F.to_json(F.transform("r", lambda x: x["record"]), {"ignoreNullFields": "false"}).alias("payload"),
        )
    )


def synonym_merge(terms: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Review candidates: old and suggested synonyms as one sorted set.

    suggestions(response): JSON arrays of {term_id, additional_synonyms, domain}, with or
    without a code fence.  Items with an unknown term are dropped; a reply that is no array
    gives nothing here and is listed by ``unreadable_replies``.
    """
    item = "array<struct<term_id: string, additional_synonyms: array<string>, domain: string>>"
    items = suggestions.select(F.inline(F.from_json(unfenced(F.col("response")), item)))
    none = F.array().cast("array<string>")
    return items.join(
        terms.select("term_id", "canonical_term", "synonyms", "linked_column_id"), "term_id"
    ).select(
        "term_id",
        "canonical_term",
        F.col("synonyms").alias("original_synonyms"),
        F.array_sort(F.array_union("synonyms", F.coalesce("additional_synonyms", none))).alias(
            "suggested_synonyms"
        ),
        F.coalesce("domain", F.lit("")).alias("domain"),
        "linked_column_id",
    )


def unreadable_replies(suggestions: DataFrame) -> DataFrame:
    """The replies that hold no JSON array, nulls included."""
    return suggestions.where(F.json_array_length(unfenced(F.col("response"))).isNull())


def _approved() -> Column:
    return F.coalesce(F.lower(strip(F.col("approve"))) == "y", F.lit(False))


def review_apply(terms: DataFrame, review: DataFrame, at: Column | None = None) -> DataFrame:
    """The glossary after a review(term_id, suggested_synonyms, domain, approve[, line]).

    Of several approved lines of a term the last one (by ``line``) counts; without lines, or
    among equal ones, the one that is greatest by value.
    """
    order = F.col("line") if "line" in review.columns else F.lit(0)
    change = F.struct(
        F.col("suggested_synonyms").alias("synonyms"), F.nullif(F.col("domain"), F.lit("")).alias("domain")
    )
    chosen = F.max(F.struct(order.alias("line"), change.alias("c")))
    last = review.where(_approved()).groupBy("term_id").agg(chosen.alias("m")).select("term_id", "m.c")
    hit = F.col("c").isNotNull()
    stamp = F.lit(None).cast("timestamp") if at is None else at

    def new(name: str) -> Column:
        values = {
            "synonyms": F.col("c.synonyms"),
            "domain": F.col("c.domain"),
            "source": F.lit(M.REVIEWED_SOURCES[0]),
            "updated_at": stamp,
        }
        return F.when(hit, values[name]).otherwise(F.col(name)).alias(name) if name in values else F.col(name)

    return terms.join(last, "term_id", "left").select(*[new(c) for c in terms.columns])


def review_counts(review: DataFrame) -> DataFrame:
    yes = _approved()
    return review.agg(F.count_if(yes).alias("approved"), F.count_if(~yes).alias("skipped"))


def polish_requests(catalog: DataFrame) -> DataFrame:
    """(column_id, local_name, raw_description) from `name | text` descriptions."""
    return catalog.select(
        "column_id",
        head_of(F.col("description"), F.lit("")).alias("local_name"),
        tail_of(F.col("description")).alias("raw_description"),
    )


def description_upsert(catalog: DataFrame, polished: DataFrame, at: Column | None = None) -> DataFrame:
    """Replaces descriptions by polished(column_id, description) where one came back."""
    new = polished.groupBy("column_id").agg(F.max("description").alias("new_text"))
    out = catalog.join(new, "column_id", "left")
    stamp = F.when(F.col("new_text").isNotNull(), at) if at is not None else None
    return out.select(
        *[
            F.coalesce("new_text", "description").alias(c) if c == "description"
            else F.coalesce(stamp, F.col(c)).alias(c) if c == "updated_at" and stamp is not None
            else F.col(c)
            for c in catalog.columns
        ]
    )


def glossary_texts(terms: DataFrame) -> DataFrame:
    """(term_id, text) of reviewed terms: canonical, synonyms and description."""
    text = F.concat_ws(
        " ",
        F.coalesce("canonical_term", F.lit("")),
        F.coalesce(F.array_join("synonyms", ","), F.lit("")),
        F.coalesce("description", F.lit("")),
    )
    return terms.where(F.col("source").isin(M.REVIEWED_SOURCES)).select(
        "term_id", strip(text).alias("text")
    )


def column_texts(catalog: DataFrame) -> DataFrame:
    return catalog.select("column_id", F.col("description").alias("text"))


def rebuild_vectors(texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding) of the vectors that came back; write it with mode overwrite."""
    return texts.select(key).join(vectors.select(key, "embedding"), key)
