"""Text quality by supervised subword embeddings in NumPy.

Words and the text's character n-grams, as written, are hashed to learned vectors; a document is the
mean of its vectors, and a softmax over two classes reads it.  N-grams hold blanks as well: how words,
sentences and lines meet tells more of quality than n-grams within words alone.  Fitted on a bounded sample of labelled rows.
As both steps are linear, scoring needs one number a feature: the difference of the two classes'
logits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.labels import held_out, labelled
from specweave.llm.words import NOT_SPACE, Words, mixed, reduced, texts_of, words_of

WORD_BUCKETS = 1 << 18
GRAM_BUCKETS = 1 << 18
GRAMS = (1, 2, 3)  # characters
SIZE = 8
EPOCHS = 4
RATE = 0.2
LEAST_DOCUMENTS = 5
MODULUS, REMAINDER = 4, 2
KEEP_AT = 0.7


def characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All characters, each the number that its UTF-8 bytes spell, and the bounds of the texts."""
    data = words.data
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[starts].astype(np.uint64)
    inside = np.ones(len(starts), bool)
    for j in (1, 2, 3):
        after = np.minimum(starts + j, len(data) - 1)
        inside &= (starts + j < len(data)) & ((data[after] & 0xC0) == 0x80)
        code = np.where(inside, code << np.uint64(8) | data[after], code)
    return code, np.searchsorted(starts, words.bounds)


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, bounds of the texts) for the words and for every size of n-gram; an n-gram may hold
    blanks but no border of a text."""
    yield (words.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int64), words.of
    chars, bounds = characters(words)
    owner = np.repeat(np.arange(words.n), np.diff(bounds))
    for size in GRAMS:
        n = max(0, len(chars) - size + 1)
        code = np.full(n, size, np.uint64)
        for j in range(size):
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += chars[j : j + n]
        code = (mixed(code) % np.uint64(GRAM_BUCKETS)).astype(np.int64) + WORD_BUCKETS
        whole = owner[:n] == owner[size - 1 :] if n else np.zeros(0, bool)
        before = np.concatenate(([0], np.cumsum(whole)))
        yield code[whole], before[np.minimum(bounds, n)]


def _sparse(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, distinct buckets and their shares of all features for every text)."""
    for first, _, data, bounds in texts_of(column):
        words = words_of(data, bounds, NOT_SPACE, False)
        parts = list(features(words))
        out = []
        for d in range(words.n):
            all_of = np.concatenate([f[of[d] : of[d + 1]] for f, of in parts])
            own, n = np.unique(all_of, return_counts=True)
            out.append((own.astype(np.int32), (n / max(1, len(all_of))).astype(np.float32)))
        yield first, out


def trained(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 6
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vector of every bucket by its row, rows of buckets, weights and base of both classes).

    Buckets of fewer than LEAST_DOCUMENTS documents have the zero vector.  Stochastic gradient descent (steps scaled as in Adagrad), one document a step, both classes
    weighing the same.
    """
    rng = np.random.default_rng(seed)
    n = WORD_BUCKETS + GRAM_BUCKETS
    seen_in = np.zeros(n, np.int64)
    for own, _ in rows:
        seen_in[own] += 1
    row_of = np.zeros(n, np.int32)
    known = np.flatnonzero(seen_in >= LEAST_DOCUMENTS)
    row_of[known] = np.arange(1, len(known) + 1)
    vectors = rng.normal(0, 0.1, (len(known) + 1, SIZE))
    vectors[0] = 0
    out, base = rng.normal(0, 0.5, (SIZE, 2)), np.zeros(2)
    seen, seen_out, seen_base = np.full(vectors.shape, 1e-6), np.full(out.shape, 1e-2), np.full(2, 1e-2)
    weight = np.where(labels == 1, len(labels) / max(1, 2 * labels.sum()), len(labels) / max(1, 2 * (labels == 0).sum()))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for d in rng.permutation(len(rows)):
            own, share = rows[d]
            at = row_of[own]
            own, share = at[at > 0], share[at > 0]
            mean = share @ vectors[own]
            logits = mean @ out + base
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[d]] -= 1
            g = p * weight[d]
            d_out, d_mean = np.outer(mean, g), out @ g
            seen_out += d_out**2
            out -= rate * d_out / np.sqrt(seen_out)
            seen_base += g**2
            base -= rate * g / np.sqrt(seen_base)
            d_own = share[:, None] * d_mean
            seen[own] += d_own**2
            vectors[own] -= rate * d_own / np.sqrt(seen[own])
    return vectors, row_of, out, base


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 6) -> tuple[np.ndarray, float]:
    """The difference of the classes' logits for every bucket, and its base."""
    vectors, row_of, out, base = trained(rows, labels, seed)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)[row_of], float(base[1] - base[0])


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """The fitted table and base; nothing where the sample does not hold both labels."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in _sparse(batch.column("text")):
                part = batch.slice(first, len(rows))
                raw = [pa.array([x[i].tobytes() for x in rows], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *raw, part.column("label")], names=["doc_id", "own", "share", "label"]
                )

    sample = labelled(docs, labels, "quality", MODULUS, REMAINDER)
    rows = sample.mapInArrow(counted, "doc_id long, own binary, share binary, label int").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return fit([(np.frombuffer(r.own, np.int32), np.frombuffer(r.share, np.float32)) for r in rows], y)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per input row.

    ``score`` is the probability of label 1; ``predicted`` is 1 at KEEP_AT or more.  Null and empty
    texts have no features and get the score of the base alone; repeated rows and rows without id stay
    rows of their own.  With labels of one kind or none every score is 1.  Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, _, data, bounds in texts_of(batch.column("text")):
                words = words_of(data, bounds, NOT_SPACE, False)
                score = np.ones(words.n)
                if model is not None:
                    table, base = model
                    total, n = np.zeros(words.n), np.zeros(words.n)
                    for buckets, of in features(words):
                        total += reduced(np.add, table[buckets].astype(np.float64), of)
                        n += np.diff(of)
                    score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + base, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, words.n), pa.array(score)], names=["doc_id", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP_AT, 1).otherwise(0).alias("predicted"),
    )
