"""Toxicity by a convolutional text classifier in NumPy.

Words are hashed to learned vectors; filters of several widths slide over them, each keeps its
largest value over the whole text, and a logistic unit reads those.  Fitted on three quarters of all
labelled rows, dealt to shards: in every round each shard runs once over its rows from the same weights, and
the changes are averaged (iterative parameter mixing, McDonald, Hall and Mann, NAACL 2010).  Thresholds are
set by language on all rows of the other quarter.

For scoring, every filter is multiplied into the word table beforehand, so a position costs one
row lookup for each filter width and offset.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.labels import all_labelled, held_out
from specweave.llm.tables import stored
from specweave.llm.words import LETTERS, reduced, texts_of, words_of

BUCKETS = 1 << 20
LEAST_DOCUMENTS = 3  # a bucket in fewer documents tells nothing
DROPPED = 0.3  # share of words left out at random in each step of fitting
SIZE = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS)  # so that a text without words has a window too
EPOCHS = 6
RATE = 0.1
MODULUS, REMAINDER = 5, 0
CALIBRATION_ROWS = 20
SHARD_ROWS = 10_000
SHARD_BYTES = 32 << 20
STEPS = 100  # log odds are counted in hundredths for the thresholds
FINE = 2.0**32  # changes are added as integers, so that their order does not matter
HIGH = 2.0**44  # multiples of it are added apart: no sum of less than a million shards leaves 64 bits
BLOCK = 4096  # rows of words whose changes travel together
SCORES = "doc_id long, score double"


def word_ids(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, buckets of the words of consecutive texts, bounds); every text ends in PAD paddings."""
    for first, _, data, bounds in texts_of(column):
        words = words_of(data, bounds, LETTERS, True)
        ids = (words.hashes() % np.uint64(BUCKETS)).astype(np.int32)
        of = words.of + PAD * np.arange(len(words.of))
        out = np.full(of[-1], BUCKETS, np.int32)
        out[np.arange(len(ids)) + PAD * words.text_of()] = ids
        yield first, out, of


@dataclass
class Model:
    """``tables[w][j]``: what a word adds to every filter of a width at an offset, in the row that
    ``rows`` gives its bucket; row 0 stands for unknown words and paddings and adds nothing."""

    rows: np.ndarray
    tables: dict[int, list[np.ndarray]]
    bias: np.ndarray
    out: np.ndarray
    base: float

    def scores(self, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        # windows start at the words, or at the first padding of a text without words
        ends = np.maximum(of[1:] - PAD, of[:-1] + 1)
        starts = ids != BUCKETS
        starts[of[:-1]] = True
        at = np.flatnonzero(starts)
        bounds = np.concatenate(([0], np.cumsum(ends - of[:-1])))
        pooled = []
        ids = self.rows[ids]
        for width, parts in self.tables.items():
            total = parts[0][ids[at]]
            for j in range(1, width):
                total += parts[j][ids[at + j]]
            pooled.append(reduced(np.maximum, total, bounds))
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        logits = (hidden * self.out).sum(1, dtype=np.float64) + self.base
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


class Weights:
    """What is learned, and the sums of squares by which its steps are scaled: a row of ``words`` for each
    known bucket, and ``dense`` for all others, of which ``filters``, ``bias``, ``out`` and ``base`` are parts."""

    def __init__(self, words: np.ndarray, seen_words: np.ndarray, dense: np.ndarray, seen_dense: np.ndarray):
        self.words, self.seen_words, self.dense, self.seen_dense = words, seen_words, dense, seen_dense
        self.filters, self.bias, self.out, self.base = self._parts(dense)
        self.seen, self.seen_bias, self.seen_out, self.seen_base = self._parts(seen_dense)

    @staticmethod
    def _parts(flat: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        filters, at = {}, 0
        for w in WIDTHS:
            size = w * SIZE * FILTERS
            filters[w] = flat[at : at + size].reshape(w, SIZE, FILTERS)
            at += size
        n = FILTERS * len(WIDTHS)
        return filters, flat[at : at + n], flat[at + n : at + 2 * n], flat[at + 2 * n :]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.words, self.seen_words, self.dense, self.seen_dense

    def tables(self) -> Iterator[tuple[int, np.ndarray]]:
        """(width, table of an offset), one at a time."""
        for w, f in self.filters.items():
            for j in range(w):
                yield w, (self.words @ f[j]).astype(np.float32)

    def rest(self) -> tuple[np.ndarray, np.ndarray, float]:
        return self.bias.astype(np.float32), self.out.astype(np.float32), float(self.base[0])

    def model(self, row_of: np.ndarray) -> Model:
        return Model(row_of, _by_width(self.tables()), *self.rest())


def _by_width(tables: Iterable[tuple[int, np.ndarray]]) -> dict[int, list[np.ndarray]]:
    out: dict[int, list[np.ndarray]] = {w: [] for w in WIDTHS}
    for w, table in tables:
        out[w].append(table)
    return out


class ShippedModel:
    """A model for all tasks, each array on its own: the driver makes one at a time, a task holds each once."""

    def __init__(self, spark: SparkSession, at: Weights, known: np.ndarray):
        cast = spark.sparkContext.broadcast
        self.known, self.rest = cast(known), at.rest()
        self.tables = [(w, cast(table)) for w, table in at.tables()]

    def opened(self) -> Model:
        return Model(rows_of(self.known.value), _by_width((w, table.value) for w, table in self.tables), *self.rest)


def started(n_words: int, rng: np.random.Generator) -> Weights:
    words = rng.normal(0, 0.3, (n_words + 1, SIZE))
    words[0] = 0
    filters = [rng.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS]
    n = FILTERS * len(WIDTHS)
    dense = np.concatenate([*(f.ravel() for f in filters), np.zeros(n), rng.normal(0, 0.3, n), [0.0]])
    return Weights(words, np.full(words.shape, 1e-2), dense, np.full(len(dense), 1e-2))


def rows_of(known: np.ndarray) -> np.ndarray:
    """The row of every bucket; 0 for those that too few documents hold."""
    row_of = np.zeros(BUCKETS + 1, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    return row_of


def class_weights(n_other: int, n_toxic: int) -> tuple[float, float]:
    n = n_other + n_toxic
    return n / max(1, 2 * n_other), n / max(1, 2 * n_toxic)


def epoch(at: Weights, texts: list[np.ndarray], labels: np.ndarray, weights: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """One round of stochastic gradient descent (steps scaled as in Adagrad), one document a step; how
    many steps have changed each row of words."""
    steps = np.zeros(len(at.words), np.int64)
    words, out, bias = at.words, at.out, at.bias
    for d in rng.permutation(len(texts)):
        ids = np.where(rng.random(len(texts[d])) < DROPPED, 0, texts[d])
        t = max(1, len(ids) - PAD)
        x = words[ids]
        peaks, places = [], []
        for w, f in at.filters.items():
            values = sum(x[j : j + t] @ f[j] for j in range(w))
            best = values.argmax(0)
            peaks.append(values[best, np.arange(FILTERS)])
            places.append(best)
        hidden = np.maximum(np.concatenate(peaks) + bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ out + at.base[0], -50, 50)))
        g = (p - labels[d]) * weights[int(labels[d])]
        step = g * out * (hidden > 0)
        at.seen_out += (g * hidden) ** 2
        out -= RATE * g * hidden / np.sqrt(at.seen_out)
        at.seen_bias += step**2
        bias -= RATE * step / np.sqrt(at.seen_bias)
        at.seen_base += g * g
        at.base -= RATE * g / np.sqrt(at.seen_base)
        rows, changes = [], []
        for k, (w, f) in enumerate(at.filters.items()):
            part = step[k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                place = places[k] + j
                rows.append(ids[place])
                changes.append(part[:, None] * f[j].T)
                d_f = x[place].T * part
                at.seen[w][j] += d_f**2
                f[j] -= RATE * d_f / np.sqrt(at.seen[w][j])
        row, change = np.concatenate(rows), np.concatenate(changes)
        own, where = np.unique(row, return_inverse=True)
        total = np.zeros((len(own), SIZE))
        np.add.at(total, where, change)
        at.seen_words[own] += total**2
        words[own] -= RATE * total / np.sqrt(at.seen_words[own])
        words[0] = 0
        steps[own] += 1
    return steps


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 9) -> Model:
    """All rounds over one list of texts."""
    rng = np.random.default_rng(seed)
    seen_in = np.zeros(BUCKETS + 1, np.int64)
    for ids in texts:
        seen_in[np.unique(ids)] += 1
    row_of = rows_of(known := np.flatnonzero(seen_in[:BUCKETS] >= LEAST_DOCUMENTS))
    at = started(len(known), rng)
    texts = [row_of[ids] for ids in texts]
    weights = class_weights(int((labels == 0).sum()), int((labels == 1).sum()))
    for _ in range(EPOCHS):
        epoch(at, texts, labels, weights, rng)
    return at.model(row_of)


def _shards(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``shard, rows(doc_id, ids, lang, label, back)``: every labelled document outside the fold, by id; a quarter
    is kept back.  Of rows that repeat an id the one with the smallest ids counts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, of in word_ids(batch.column("text")):
                part = batch.slice(first, len(of) - 1)
                raw = pa.array([ids[a:b].tobytes() for a, b in zip(of[:-1], of[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), raw, part.column("lang")], names=["doc_id", "ids", "lang"])

    texts, known = all_labelled(docs, labels, "toxic", MODULUS, REMAINDER)
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int")
    rows = texts.mapInArrow(hashed, "doc_id long, ids binary, lang string").select("doc_id", F.struct("ids", "lang").alias("row"))
    # what follows is by shard, so the ids are shuffled once
    both = rows.unionByName(known, allowMissingColumns=True).withColumn("shard", shard).repartition(n_shards, "shard")
    rows = both.groupBy("shard", "doc_id").agg(F.min("row").alias("row"), F.max("label").alias("label"))
    rows = rows.where("row is not null and label is not null")
    row = F.struct("doc_id", "row.ids", "row.lang", "label", (F.pmod("doc_id", F.lit(4)) == 1).alias("back"))
    return stored(rows.groupBy("shard").agg(F.sort_array(F.collect_list(row)).alias("rows")), maxRecordsPerFile=1)


def _opened(batches: Iterator[pa.RecordBatch], back: bool | None) -> Iterator[tuple[int, list[np.ndarray], pa.StructArray]]:
    """(shard, ids of its texts, its rows) for every shard; those kept back, the others, or all."""
    for batch in batches:
        for number, held in zip(batch.column("shard").to_pylist(), batch.column("rows")):
            rows = held.values
            if back is not None:
                rows = rows.filter(pc.equal(rows.field("back"), back))
            yield number, [np.frombuffer(x.as_buffer(), np.int32) for x in rows.field("ids")], rows


_CHANGES = "block int, high boolean, rows binary, sums binary"
_MEANS = "block int, rows binary, means binary"


def _split(block: int, rows: np.ndarray, n: np.ndarray, change: np.ndarray) -> Iterator[tuple]:
    """Changes times ``n`` as integers beside ``n``, what is above HIGH apart; rows without that have no such part."""
    scaled = np.rint(change * n[:, None] * FINE)
    high = np.rint(scaled / HIGH)
    for is_high, part in ((False, scaled - high * HIGH), (True, high)):
        own = high.any(1) if is_high else np.ones(len(rows), bool)
        if own.any():
            sums = np.hstack([n[own, None], part[own].astype(np.int64)])
            yield block, is_high, rows[own].astype(np.int32).tobytes(), sums.astype(np.int64).tobytes()


def _changed(before: Weights, after: Weights, own: np.ndarray, steps: np.ndarray, n_rows: int) -> pa.RecordBatch:
    """Changes of the rows of words, ``own`` of them, by how many steps have made them, in blocks; in block -1 those of
    all else by documents, SIZE in a row."""
    moved = np.flatnonzero(steps)
    moved = moved[moved > 0]
    of, out = own[moved] // BLOCK, []
    for block in np.unique(of):
        at = moved[slice(*np.searchsorted(of, (block, block + 1)))]
        change = np.hstack([after.words[at] - before.words[at], after.seen_words[at] - before.seen_words[at]])
        out += _split(int(block), own[at] % BLOCK, steps[at], change)
    pad = -len(before.dense) % SIZE
    dense = [np.pad(b - a, (0, pad)).reshape(-1, SIZE) for a, b in ((before.dense, after.dense), (before.seen_dense, after.seen_dense))]
    out += _split(-1, np.arange(len(dense[0])), np.full(len(dense[0]), n_rows), np.hstack(dense))
    return _records(out, (pa.int32(), pa.bool_(), pa.binary(), pa.binary()), _CHANGES)


def _records(rows: list[tuple], types: tuple[pa.DataType, ...], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of every row of a block that a shard has changed."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, high, rows, sums in zip(*(c.to_pylist() for c in batch.columns)):
            if block not in totals:
                totals[block] = np.zeros((2, BLOCK, 1 + 2 * SIZE), np.int64)
            # a shard names a row once
            totals[block][int(high), np.frombuffer(rows, np.int32)] += np.frombuffer(sums, np.int64).reshape(-1, 1 + 2 * SIZE)
    for block, (low, high) in totals.items():
        rows = np.flatnonzero(low[:, 0])
        means = (low[rows, 1:] + high[rows, 1:] * HIGH) / FINE / low[rows, :1]
        yield _records([(block, rows.astype(np.int32).tobytes(), means.tobytes())], (pa.int32(), pa.binary(), pa.binary()), _MEANS)


def _mix(at: Weights, means: Iterable[tuple[int, bytes, bytes]]) -> None:
    """Move weights by the mean of the shards' changes."""
    for block, rows, values in means:
        own, mean = np.frombuffer(rows, np.int32), np.frombuffer(values).reshape(-1, 2 * SIZE)
        if block < 0:
            at.dense += mean[:, :SIZE].ravel()[: len(at.dense)]
            at.seen_dense += mean[:, SIZE:].ravel()[: len(at.dense)]
        else:
            at.words[block * BLOCK + own] += mean[:, :SIZE]
            at.seen_words[block * BLOCK + own] += mean[:, SIZE:]


def fitted(shards: DataFrame, n_other: int, n_toxic: int, back: bool | None, seed: int = 9) -> ShippedModel:
    """A model of all rows of the shards (see :func:`_opened`), of which a task holds one shard at a time.

    The driver holds what every task gets: the weights, whose size BUCKETS bounds.  A task moves only the rows of its
    shard's words; their means come to the driver a partition at a time.
    """

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_in = np.zeros(BUCKETS + 1, np.int64)
        for _, texts, _ in _opened(batches, back):
            for ids in texts:
                seen_in[np.unique(ids)] += 1
        at = np.flatnonzero(seen_in[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen_in[at])], names=["bucket", "n"])

    counted = shards.mapInArrow(holders, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") >= LEAST_DOCUMENTS).toArrow()
    known = np.sort(counted.column("bucket").to_numpy())
    del counted
    weights = class_weights(n_other, n_toxic)
    at = started(len(known), np.random.default_rng(seed))
    for k in range(EPOCHS):
        sent = shards.sparkSession.sparkContext.broadcast((*at.arrays(), known))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            words, seen_words, *dense, known = sent.value
            row_of = rows_of(known)
            for number, texts, rows in _opened(batches, back):
                met = np.zeros(len(words), bool)
                met[0] = True
                for ids in texts:
                    met[row_of[ids]] = True
                own = np.flatnonzero(met)
                place = np.zeros(len(words), np.int32)
                place[own] = np.arange(len(own))
                place = place[row_of]
                before = Weights(words[own], seen_words[own], *dense)
                after = Weights(*(a.copy() for a in before.arrays()))
                labels = rows.field("label").to_numpy(zero_copy_only=False)
                steps = epoch(after, [place[ids] for ids in texts], labels, weights, np.random.default_rng((seed, k, number)))
                yield _changed(before, after, own, steps, len(texts))

        _mix(at, shards.mapInArrow(run, _CHANGES).repartition("block").mapInArrow(_means, _MEANS).toLocalIterator())
        sent.destroy()
    return ShippedModel(shards.sparkSession, at, known)


def threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Where the share of toxic rows caught less the share of others caught is largest; of equally
    good values the nearest to 0.5.  ``counts``: how many rows each score stands for."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    order = np.sort(np.unique(np.concatenate((scores, [0.0, 1.0]))))
    # one half stands for the stretch that holds it
    tries = np.unique(np.concatenate(((order[1:] + order[:-1]) / 2, [0.5])))

    def caught(of: int) -> np.ndarray:
        at = np.argsort(scores[labels == of], kind="stable")
        own, n = scores[labels == of][at], np.concatenate(([0], np.cumsum(counts[labels == of][at])))
        return 1 - n[np.searchsorted(own, tries)] / max(1, n[-1])

    gain = np.round(caught(1) - caught(0), 9)
    best = tries[gain == gain.max()]
    return float(best[np.abs(best - 0.5).argmin()])


def learned(docs: DataFrame, labels: DataFrame) -> tuple[ShippedModel | None, dict[str | None, float]]:
    """A model and thresholds by language; ``None`` stands for languages with too few rows.

    Without rows of both labels there is no model.
    """

    shards = _shards(docs, labels)
    each = shards.select(F.explode("rows").alias("row")).groupBy("row.back", "row.label").count().collect()
    n = {(r["back"], r["label"]): r["count"] for r in each}
    train, back = ([n.get((b, v), 0) for v in (0, 1)] for b in (False, True))
    if not all(x + y for x, y in zip(train, back)):
        return None, {None: 0.5}
    if not all(train) or not all(back):
        return fitted(shards, *(x + y for x, y in zip(train, back)), None), {None: 0.5}
    sent = fitted(shards, *train, False)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.opened()
        for _, texts, rows in _opened(batches, True):
            if texts:
                score = model.scores(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
                score = np.clip(score, 1e-300, 1 - 1e-16)
                odds = np.rint(STEPS * np.log(score / (1 - score))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.field("lang"), pa.array(odds), rows.field("label")], names=["lang", "odds", "label"])

    # a row for each language, hundredth of log odds and label
    found = shards.mapInArrow(placed, "lang string, odds long, label int").groupBy("lang", "odds", "label").count().collect()
    by: dict[str | None, list[tuple]] = defaultdict(list)
    for r in found:
        row = (1 / (1 + np.exp(-r["odds"] / STEPS)), r["label"], r["count"])
        by[None].append(row)
        if r["lang"] is not None:
            by[r["lang"]].append(row)
    cuts: dict[str | None, float] = {}
    for lang, own in sorted(by.items(), key=str):
        scores, marks, counts = (np.array(x) for x in zip(*own))
        if lang is None or min(np.bincount(marks, counts, minlength=2)) >= CALIBRATION_ROWS:
            cuts[lang] = threshold(scores, marks, counts)
    return sent, cuts


def _scored(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.zeros(len(column))
    parts = [model.scores(ids, of) for _, ids, of in word_ids(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected``: one row per input row.

    ``predicted`` is 1 at a score of 0.5 or more; ``rejected`` compares the score with the threshold
    of the row's language, which is no input of the score.  Null and empty texts are scored as texts
    without words; repeated rows and rows without id or language stay rows of their own.  With labels
    of one kind or none every score is 0.  Other columns are not read.
    """
    sent, cuts = learned(docs, labels)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent and sent.opened()
        for batch in batches:
            score = _scored(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(score)], names=["doc_id", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    cut = F.lit(cuts[None])
    for name, value in cuts.items():
        if name is not None:
            cut = F.when(F.col("lang") == name, F.lit(value)).otherwise(cut)
    return rows.mapInArrow(run, "doc_id long, lang string, score double").select(
        "doc_id",
        held_out(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        cut.alias("threshold"),
        (F.col("score") >= cut).alias("rejected"),
    )


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`toxicity` does not reject."""
    sent, cuts = learned(docs, labels)
    if sent is None:
        return docs
    names = [n.lower() for n in docs.columns]
    text_at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.opened()
        for batch in batches:
            langs = [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()
            limit = np.array([cuts.get(x, cuts[None]) for x in langs])
            yield batch.filter(pa.array(_scored(model, batch.column(text_at)) < limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
