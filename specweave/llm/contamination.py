"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-grams the smallest hash is kept, on both sides.  Two
texts that share ``window`` words share such a run and so a kept hash: no shared window is missed.
Items shorter than a window are one k-gram of their own length, of which every one is kept.

Fingerprints of both sides are tables, joined by hash.  Each carries the words around its k-gram, as
many as a window that holds the k-gram can reach, so a hit is extended where it is joined, and what
spans a whole window counts.  No text is shuffled, and neither the benchmark nor an index of it goes
to a task whole: a screen of bits, of fixed size, only tells which fingerprints of documents have no
partner.  A screen too small for a benchmark lets more of them through to the join, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.tables import narrowed, stored
from specweave.llm.words import LETTERS, Words, texts_of, words_of

WINDOW = 10
K = 5
BLOCK_BYTES = 8 << 20
LONG_WORD = 32
BATCH = 4096
CACHED = 1 << 12
PRINT = "size int, hash long, words binary, before int"
Print = tuple[int, int, bytes, int]


def winnow(at: np.ndarray, hashes: np.ndarray, texts: np.ndarray, run: int) -> np.ndarray:
    """Indices of the k-grams kept: the smallest hash, the last of equal ones, of every ``run``
    consecutive k-grams of one text; of a text with fewer k-grams none is needed."""
    n = len(hashes) - run + 1
    if run <= 1 or n <= 0:
        return np.arange(len(hashes) if run <= 1 else 0)
    best = np.arange(n)
    low = hashes[:n].copy()
    for j in range(1, run):
        other = hashes[j : j + n]
        better = other <= low
        low = np.where(better, other, low)
        best = np.where(better, np.arange(j, j + n), best)
    return np.unique(best[texts[:n] == texts[run - 1 :]])


def gram_of(size: int, window: int, k: int) -> int:
    """Words in the k-grams of items of this size."""
    return min(k, window) if size == window else size


def fingerprints(texts: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of every k-gram kept for windows of ``size`` words."""
    at, grams = texts.grams(texts.hashes(), gram)
    owner = np.searchsorted(texts.of, at, "right") - 1
    keep = winnow(at, grams, owner, size - gram + 1)
    return owner[keep], at[keep], grams[keep]


def around(texts: Words, doc: int, at: int, size: int, gram: int) -> tuple[bytes, int]:
    """The words that windows with the k-gram at word ``at`` can hold, and how many stand before it.

    A blank is between two words; a long word is given by its digest, behind a byte that no word has.
    """
    low = max(int(texts.of[doc]), at - (size - gram))
    high = min(int(texts.of[doc + 1]), at + size)
    words = [texts.data[a:b].tobytes() for a, b in zip(texts.starts[low:high].tolist(), texts.ends[low:high].tolist())]
    return b" ".join(w if len(w) <= LONG_WORD else b"\x01" + sha256(w).digest().hex().encode() for w in words), at - low


def extended(own: bytes, before: int, other: bytes, other_before: int, gram: int) -> tuple[int, int]:
    """How many words are equal before the k-gram, and from its first word on."""
    a, b = own.split(b" "), other.split(b" ")
    low = high = 0
    while low < min(before, other_before) and a[before - low - 1] == b[other_before - low - 1]:
        low += 1
    while high < min(len(a) - before, len(b) - other_before) and a[before + high] == b[other_before + high]:
        high += 1
    return (low, high) if high >= gram else (0, 0)


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def _item_prints(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``item`` and the fingerprints of its windows, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in texts_of(batch.column("text")):
                texts = words_of(data, bounds, LETTERS, True)
                sizes = np.minimum(texts.counts(), window)
                for size in sorted(set(sizes.tolist()) - {0}):
                    gram = gram_of(size, window, k)
                    owner, at, grams = fingerprints(texts, size, gram)
                    mine = np.flatnonzero(sizes[owner] == size)
                    for low in range(0, len(mine), BATCH):
                        i = mine[low : low + BATCH]
                        spans = [around(texts, d, p, size, gram) for d, p in zip(owner[i].tolist(), at[i].tolist())]
                        columns = [
                            batch.column("item").take(pa.array(first + owner[i])),
                            pa.array([size] * len(i), pa.int32()),
                            pa.array(_signed(grams[i]), pa.int64()),
                            pa.array([s[0] for s in spans], pa.binary()),
                            pa.array([s[1] for s in spans], pa.int32()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["item", "size", "hash", "words", "before"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return stored(items.where("text is not null").mapInArrow(run, f"item string, {PRINT}").distinct())


def _screen(prints: DataFrame, block_bytes: int) -> np.ndarray:
    """One bit for every fingerprint, in at most ``block_bytes`` (eight bytes at least) whatever the benchmark."""
    bits = 1 << max(6, (block_bytes * 8).bit_length() - 1)
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    slots = prints.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = slots.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _text_key(text: Column) -> Column:
    """What a text's fingerprints are joined by; equal texts are searched once."""
    return F.sha2(text.cast("string").cast("binary"), 256)


def _doc_prints(docs: DataFrame, prints: DataFrame, window: int, k: int, block_bytes: int) -> DataFrame:
    """A row ``doc_id, key, n_words`` for every document, and rows ``key, at`` and a fingerprint
    for those that the screen lets through; ``size`` is null in the former."""
    sizes = sorted(r.size for r in prints.select(F.col("size")).distinct().collect())  # at most ``window``
    sent = docs.sparkSession.sparkContext.broadcast(_screen(prints, block_bytes))
    names = ["doc_id", "key", "n_words", "at", "size", "hash", "words", "before"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32()]

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = sent.value
        mask = np.uint64(len(screen) * 64 - 1)
        for batch in batches:
            for first, last, data, bounds in texts_of(batch.column("text")):
                texts = words_of(data, bounds, LETTERS, True)
                part = batch.slice(first, last - first)
                yield batch_of(texts.n, {"doc_id": part["doc_id"], "key": part["key"], "n_words": pa.array(texts.counts())})
                for size in sizes:
                    gram = gram_of(size, window, k)
                    owner, at, grams = fingerprints(texts, size, gram)
                    slot = grams & mask
                    may = np.flatnonzero(screen[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                    for low in range(0, len(may), BATCH):
                        i = may[low : low + BATCH]
                        spans = [around(texts, d, p, size, gram) for d, p in zip(owner[i].tolist(), at[i].tolist())]
                        yield batch_of(
                            len(i),
                            {
                                "key": part["key"].take(pa.array(owner[i])),
                                "at": pa.array(at[i] - texts.of[owner[i]]),
                                "size": pa.array([size] * len(i)),
                                "hash": pa.array(_signed(grams[i])),
                                "words": pa.array([s[0] for s in spans], pa.binary()),
                                "before": pa.array([s[1] for s in spans]),
                            },
                        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _text_key(F.col("text")).alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    return stored(rows.mapInArrow(run, f"doc_id long, key string, n_words long, at long, {PRINT}"))


def _spans(found: DataFrame, prints: DataFrame, window: int, k: int) -> DataFrame:
    """``key, start, end, item``: spans of a window or more that a text shares with an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = lru_cache(CACHED)(extended)  # passages that many documents hold
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("size", "words", "before", "item_words", "item_before")]
            spans = [reach(w, b, v, c, gram_of(s, window, k)) for s, w, b, v, c in zip(*columns)]
            keep = pa.array([i for i, (s, (low, high)) in enumerate(zip(columns[0], spans)) if low + high >= s], pa.int64())
            ends = np.array(spans, np.int64).reshape(-1, 2)[keep.to_numpy()]
            at = batch.column("at").take(keep).to_numpy()
            out = [batch.column("key").take(keep), pa.array(at - ends[:, 0]), pa.array(at + ends[:, 1]), batch.column("item").take(keep)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "start", "end", "item"])

    items = prints.withColumnsRenamed({"words": "item_words", "before": "item_before"})
    # copies of a text give their fingerprints once
    own = found.where("size is not null").drop("doc_id", "n_words").distinct()
    return own.join(items, ["size", "hash"]).mapInArrow(run, "key string, start long, end long, item string")


def _united(spans: Column) -> Column:
    """Words in the union of spans."""
    zero = F.lit(0).cast("long")

    def longer(s: Column, x: Column) -> Column:
        more = x["end"] - F.greatest(s["reach"], x["start"])
        return F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), (s["n"] + F.greatest(zero, more)).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("reach"), zero.alias("n")), longer, lambda s: s["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """What of every document stands in the benchmark.

    One row per input row: ``n_words``, ``n_hit`` (words inside any occurrence of a window of
    ``window`` consecutive words of an item; a shorter item is one window), ``n_items``,
    ``items_sha256`` (of the sorted ids, joined by commas) and ``contaminated``.  Items without id count as
    one item, which has no place among the ids.  ``block_bytes`` bounds the screen that every task holds;
    it changes no result.

    Null and empty texts have no words; null ids and repeated rows stay rows of their own.  Items
    without words match nothing; repeated items count once.  An empty benchmark marks
    nothing.  Other columns are not read.
    """
    prints = _item_prints(benchmark, window, k)
    found = _doc_prints(docs, prints, window, k, block_bytes)
    hits = _spans(found, prints, window, k).groupBy("key").agg(
        _united(F.collect_set(F.struct("start", "end"))).alias("n"),
        F.sort_array(F.collect_set("item")).alias("items"),
        F.max(F.col("item").isNull().cast("long")).alias("without_id"),
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n", F.lit(0).cast("long"))
    return found.where("size is null").select("doc_id", "key", "n_words").join(hits, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        (F.size(items) + F.coalesce("without_id", F.lit(0).cast("long"))).alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text holds no window of the benchmark.

    Edge cases as in :func:`contamination`: rows without text or words stay.
    """
    prints = _item_prints(benchmark, window, k)
    found = _doc_prints(docs, prints, window, k, block_bytes)
    name = "text_key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    marked = stored(_spans(found, prints, window, k).select(F.col("key").alias(name)).distinct())
    return narrowed(docs.withColumn(name, _text_key(F.col("text"))), marked, "left_anti").drop(name)
