"""The stored catalog and glossary, changed bucket by bucket; see ``sources.buckets``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from specweave.operators.glossary import description_upsert, review_apply
from specweave.operators.judge import tag_upsert
from specweave.sources.buckets import BUCKETS, upsert_buckets

COLUMN, TERM = ["column_id"], ["term_id"]


def store_tags(writes: DataFrame, path: str, schema: str, order: list[str], buckets: int = BUCKETS) -> None:
    """``judge.tag_upsert`` of a catalog stored by column_id."""
    upsert_buckets(writes, path, schema, COLUMN, lambda stored, new: tag_upsert(stored, new, order), buckets)


def store_descriptions(polished: DataFrame, path: str, schema: str, buckets: int = BUCKETS) -> None:
    """``glossary.description_upsert`` of a catalog stored by column_id."""
    upsert_buckets(polished, path, schema, COLUMN, description_upsert, buckets)


def store_reviews(review: DataFrame, path: str, schema: str, buckets: int = BUCKETS) -> None:
    """``glossary.review_apply`` of a glossary stored by term_id."""
    upsert_buckets(review, path, schema, TERM, review_apply, buckets)
