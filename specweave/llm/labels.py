"""Labelled documents for fitting classifiers, whole or as bounded samples, and folds by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.tables import crc_of_id, narrowed

PER_CLASS = 2_000
LONGEST = 200_000


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the fold that is never learned from; a null id does not."""
    return F.coalesce(crc_of_id(doc_id, modulus) == remainder, F.lit(False))


def _known(labels: DataFrame, label: str, modulus: int | None, remainder: int) -> DataFrame:
    """``doc_id, label``: ids outside the fold, if there is one, whose labels agree."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)")
    if modulus is not None:
        known = known.where(~held_out(F.col("doc_id"), modulus, remainder))
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def all_labelled(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int | None = None, remainder: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text, lang`` of every row of a document with a label outside the fold ``remainder``, and
    ``doc_id, label`` of these labels.

    Ids with contradicting labels, null labels and null texts are not used.
    """
    known = _known(labels, label, modulus, remainder)
    return narrowed(_texts(docs).where("text is not null"), known.select("doc_id"), "left_semi"), known


def labelled(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int | None = None,
    remainder: int = 0,
    per_class: int = PER_CLASS,
    longest: int = LONGEST,
) -> DataFrame:
    """``doc_id, text, lang, label``: at most ``per_class`` documents with label 0 and as many with 1.

    Chosen by a hash of the id among all labelled rows outside the fold ``remainder``, if there is one.  Ids with
    contradicting labels, null labels and texts of more than ``longest`` characters are not used; of
    rows that repeat an id the smallest text is.  ``lang`` serves to report results by language.
    """
    known = _known(labels, label, modulus, remainder)
    texts = _texts(docs).where(F.length("text") <= longest)
    order = [F.xxhash64("doc_id"), "doc_id"]
    # twice the rows, as some labels belong to no usable text
    near = [known.where(F.col("label") == v).orderBy(*order).limit(2 * per_class) for v in (0, 1)]
    wanted = near[0].union(near[1]).select("doc_id", "label")
    found = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang")).alias("row"))
    found = found.select("doc_id", "label", "row.text", "row.lang")
    parts = [found.where(F.col("label") == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "text", "lang", "label")
