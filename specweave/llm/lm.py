"""Language-model scores: word counts of the whole corpus and a log-bilinear model in NumPy.

The model predicts one of OUTPUTS symbols from the CONTEXT symbols before it: the end of a text, the
most frequent words, or one of BUCKETS groups of all other words by their last two bytes.  Within a group
it predicts one of its members, the GROUP_WORDS most frequent words that occur twice at least, or the rest
of the group; members are symbols of their own in contexts too.  Words of the rest have add-one
probabilities from the counts, so that every text has a probability.

Texts are written as symbols once.  The model is fitted on them by noise-contrastive estimation on every
position of every training text: each partition trains from the same start, and the results are averaged,
weighted by positions, in ROUNDS rounds.  Scoring multiplies batches of contexts with all outputs, and with
those of the group, and normalises both.

Counts of all words stay a table; its most frequent VOCABULARY words (a fixed number) go to the tasks, so
only rare words of a text are joined, and no join key is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.labels import held_out
from specweave.llm.tables import opened, shipped, stored
from specweave.llm.words import NOT_SPACE, Words, reduced, texts_of, words_of

MODULUS, REMAINDER = 7, 2
VOCABULARY = 1 << 18
HASH_BITS = 20
SLOT_BITS = 18
COUNTED_BYTES = 1 << 24  # of texts whose words are counted together
TOP_WORDS = 63
BUCKETS = 192
OUTPUTS = 1 + TOP_WORDS + BUCKETS
CONTEXT = 5
SIZE = 16
ROUNDS = 2
GROUP_WORDS = 172
NOISE = 64
GROUP_NOISE = 4
BATCH = 1536
SCORED = 256
SCORED_AT_ONCE = 40_000
RUN = 64
PIECE = 16
CHUNK_SYMBOLS = 1 << 18
RATE = 0.2


def buckets_of(words: Words, at: np.ndarray) -> np.ndarray:
    """The output symbols of the groups of words ``at``, by their last two bytes."""
    last = words.data[words.ends[at] - 1].astype(np.int64)
    before = words.data[np.maximum(words.ends[at] - 2, words.starts[at])].astype(np.int64)
    return 1 + TOP_WORDS + (last * 37 + before * 101) % BUCKETS


def spelled(words: Words, at: np.ndarray) -> pa.Array:
    """Words as an Arrow array of strings."""
    starts, size = words.starts[at], words.ends[at] - words.starts[at]
    bounds = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(words.data[index])]
    return pa.StringArray.from_buffers(len(at), buffers[1], buffers[2])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``token, c`` over all texts; the empty token counts their ends."""

    def merged(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        own, at, which = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(which, np.concatenate([p[2] for p in parts]), len(own)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([p[1] for p in parts]).take(pa.array(at)), pa.array(n)], names=["token", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, ends = [], 0, 0
        # the first word of every slot is counted there
        held, sums = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        slots, tokens = [], []
        for batch in batches:
            ends += batch.num_rows
            for _, _, data, bounds in texts_of(batch.column("text")):
                words = words_of(data, bounds, NOT_SPACE, True)
                hashes = np.maximum(words.hashes(), np.uint64(1))
                slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                hit = held[slot] == hashes
                sums += np.bincount(slot[hit], minlength=len(sums))
                other = np.flatnonzero(~hit)
                hashes, at, n = np.unique(hashes[other], return_index=True, return_counts=True)
                at = other[at]
                # in the order of hashes, words of one slot stand together
                slot = slot[at]
                first = (held[slot] == 0) & (np.diff(slot, prepend=-1) > 0)
                held[slot[first]], sums[slot[first]] = hashes[first], n[first]
                slots.append(slot[first])
                tokens.append(spelled(words, at[first]))
                parts.append((hashes[~first], spelled(words, at[~first]), n[~first]))
                size += len(data)
                if size >= COUNTED_BYTES:
                    yield merged(parts)
                    parts, size = [], 0
        if parts:
            yield merged(parts)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(tokens), pa.array(sums[np.concatenate(slots)])], names=["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], names=["token", "n"])

    rows = _texts(docs).select("text").mapInArrow(counted, "token string, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("c")).where("c > 0")


@dataclass
class Vocabulary:
    """The most frequent words by hash, and what the counts come to; of bounded size."""

    hashes: np.ndarray  # ascending
    counts: np.ndarray
    symbols: np.ndarray  # of TOP_WORDS, and OUTPUTS + row of members; -1 for others
    ends: int  # training texts
    total: int  # N
    kinds: int  # V
    group_logs: np.ndarray  # log10 of the denominator of the rest of every group
    noise: np.ndarray  # how often each symbol occurs
    rows: np.ndarray  # the first row of every group, that of its rest, and the number of rows
    row_noise: np.ndarray  # how often each row occurs

    @cached_property
    def _starts(self) -> np.ndarray:
        """How many hashes lie before each value of their first HASH_BITS bits."""
        return np.concatenate(([0], np.cumsum(np.bincount(_top_bits(self.hashes), minlength=1 << HASH_BITS))))

    @cached_property
    def logs(self) -> np.ndarray:
        return np.log10(self.counts + 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among those of the vocabulary, and which of them do."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place, last = self._starts[_top_bits(hashes)], len(self.hashes) - 1
        there = self.hashes[np.minimum(place, last)]
        hit, ahead = there == hashes, np.flatnonzero(there < hashes)
        while len(ahead):
            place[ahead] += 1
            ahead = ahead[place[ahead] <= last]
            there = self.hashes[place[ahead]]
            hit[ahead] = there == hashes[ahead]
            ahead = ahead[there < hashes[ahead]]
        return np.where(hit, place, 0), hit


def _top_bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _most_frequent(counts: DataFrame) -> pa.Table:
    """``token, c`` of VOCABULARY words at most, the most frequent first.

    Frequencies are binned, a sixteenth of a doubling each, and as many bins taken as fit: nothing longer is
    sorted or sent to the driver.
    """
    words = counts.where("token <> ''").withColumn("bin", F.floor(16 * F.log2("c")))
    sizes = {r.bin: r.n for r in words.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, lowest = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        taken += sizes[b]
        if taken > VOCABULARY:
            break
        lowest = b
    top = words.where(F.col("bin") >= lowest).select("token", "c").toArrow()
    return top.sort_by([("c", "descending"), ("token", "ascending")])


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = _most_frequent(counts)
    column = top.column("token").combine_chunks().cast(pa.string())
    hashes = np.concatenate(
        [words_of(d, b, NOT_SPACE, False).hashes() for _, _, d, b in texts_of(column)] or [np.empty(0, np.uint64)]
    )
    c = top.column("c").to_numpy()
    symbols = np.where(np.arange(len(c)) < TOP_WORDS, 1 + np.arange(len(c)), -1)
    order = np.argsort(hashes)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("c").to_numpy()
            for first, to, data, bounds in texts_of(batch.column("token")):
                words = words_of(data, bounds, NOT_SPACE, False)
                group = buckets_of(words, np.arange(len(words.starts)))
                own = n[first:to][words.counts() > 0]
                sums = np.bincount(group, own, OUTPUTS), np.bincount(group, minlength=OUTPUTS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(OUTPUTS)), *(pa.array(s.astype(np.int64)) for s in sums)], names=["symbol", "n", "v"]
                )

    sums = counts.mapInArrow(grouped, "symbol long, n long, v long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(OUTPUTS, np.int64), np.zeros(OUTPUTS, np.int64)
    for r in sums.collect():
        n[r.symbol], v[r.symbol] = r.n, r.v
    ends = counts.where("token = ''").agg(F.sum("c")).first()[0] or 0
    total, kinds = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
    # the top words are symbols of their own and leave their groups
    every = [words_of(d, b, NOT_SPACE, False) for _, _, d, b in texts_of(column)]
    group = np.concatenate([buckets_of(w, np.arange(len(w.starts))) for w in every] or [np.empty(0, np.int64)]).astype(np.int64)
    own = group[:TOP_WORDS]
    n -= np.bincount(own, c[: len(own)], OUTPUTS).astype(np.int64)
    v -= np.bincount(own, minlength=OUTPUTS)
    noise = n.astype(np.float64)
    noise[0] = ends
    noise[1 : 1 + len(own)] = c[: len(own)]
    # members leave the rest of their groups
    at, rank = _ranked(group, TOP_WORDS + np.flatnonzero(c[TOP_WORDS:] > 1))
    at, rank = at[rank < GROUP_WORDS], rank[rank < GROUP_WORDS]
    sizes = np.bincount(group[at], minlength=OUTPUTS)
    n -= np.bincount(group[at], c[at], OUTPUTS).astype(np.int64)
    v -= sizes
    last = 1 + TOP_WORDS + BUCKETS
    rows = np.concatenate(([0], np.cumsum(1 + sizes[1 + TOP_WORDS : last])))
    row = rows[group[at] - 1 - TOP_WORDS] + 1 + rank
    row_noise = np.empty(rows[-1])
    row_noise[rows[:-1]] = (n + v + 1)[1 + TOP_WORDS : last]
    row_noise[row] = c[at] + 1
    symbols[at] = OUTPUTS + row
    return Vocabulary(hashes[order], c[order], symbols[order], ends, total, kinds, np.log10(n + v + 1), noise + 1, rows, row_noise)


def _ranked(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``at`` ordered by group, and the place of each in its group."""
    at = at[np.argsort(group[at], kind="stable")]
    first = np.searchsorted(group[at], group[at])
    return at, np.arange(len(at)) - first


@dataclass
class Coded:
    """Texts as symbols, each text with its end, and what is known of every word."""

    words: Words
    symbols: np.ndarray
    of: np.ndarray
    hashes: np.ndarray
    place: np.ndarray  # in the vocabulary; 0 outside it
    inside: np.ndarray  # whether the vocabulary has the word
    named: np.ndarray  # whether a symbol stands for this word alone


def coded(column: pa.Array, known: Vocabulary) -> Iterator[tuple[int, Coded]]:
    for first, _, data, bounds in texts_of(column):
        words = words_of(data, bounds, NOT_SPACE, True)
        hashes = words.hashes()
        place, inside = known.places(hashes)
        symbols = np.where(inside, known.symbols[place], -1) if len(known.symbols) else np.full(len(hashes), -1)
        named = symbols >= 0
        other = np.flatnonzero(~named)
        symbols[other] = buckets_of(words, other)
        of = words.of + np.arange(len(words.of))
        out = np.zeros(of[-1], np.int64)
        out[np.arange(len(symbols)) + words.text_of()] = symbols
        yield first, Coded(words, out, of, hashes, place, inside, named)


def padded(symbols: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with CONTEXT end symbols before every text, and the new places of the old ones."""
    at = np.arange(len(symbols)) + CONTEXT * (1 + np.repeat(np.arange(len(of) - 1), np.diff(of)))
    out = np.zeros(len(symbols) + CONTEXT * (len(of) - 1), np.int64)
    out[at] = symbols
    return out, at


@dataclass
class Model:
    words: np.ndarray  # vectors of context symbols
    places: np.ndarray  # a diagonal for each place before the target
    targets: np.ndarray  # vectors of outputs, the bias last
    inner: np.ndarray  # the rows of all groups, the bias last
    rows: np.ndarray  # of the vocabulary

    @staticmethod
    def start(noise: np.ndarray, rows: np.ndarray | None = None, row_noise: np.ndarray | None = None, seed: int = 4) -> Model:
        """Without ``rows``, of groups without members."""
        rows = np.arange(BUCKETS + 1) if rows is None else rows
        row_noise = np.ones(rows[-1]) if row_noise is None else row_noise
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, (2, OUTPUTS, SIZE)).astype(np.float32)
        more = rng.normal(0, 0.1, (2, rows[-1], SIZE)).astype(np.float32)
        places = np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32)
        targets = np.column_stack((vectors[1], np.log(noise / noise.sum()).astype(np.float32)))
        inner = np.column_stack((more[1], _row_logs(rows, row_noise)))
        return Model(np.concatenate((vectors[0], more[0])), places, targets, inner, rows)

    def trainable(self) -> tuple[np.ndarray, ...]:
        return self.words, self.places, self.targets, self.inner

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.trainable()])

    @staticmethod
    def of(flat: np.ndarray, rows: np.ndarray) -> Model:
        n = rows[-1]
        shapes = [(OUTPUTS + n, SIZE), (CONTEXT, SIZE), (OUTPUTS, SIZE + 1), (n, SIZE + 1)]
        parts = np.split(flat.astype(np.float32), np.cumsum([math.prod(s) for s in shapes])[:-1])
        return Model(*(p.reshape(s).copy() for p, s in zip(parts, shapes)), rows)

    def hidden(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of all symbols of a run, a row for each of SIZE, and what predicts each position after the
        first CONTEXT ones; the last row is one, for the bias."""
        n = len(run) - CONTEXT
        vectors = np.ascontiguousarray(self.words.take(run, 0).T)
        out, part = np.ones((SIZE + 1, n), np.float32), np.empty((SIZE, n), np.float32)
        sums = np.multiply(vectors[:, CONTEXT - 1 : CONTEXT - 1 + n], self.places[0][:, None], out=out[:SIZE])
        for k in range(1, CONTEXT):
            sums += np.multiply(vectors[:, CONTEXT - 1 - k : CONTEXT - 1 - k + n], self.places[k][:, None], out=part)
        return vectors, out

    @cached_property
    def _located(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        symbols = np.arange(OUTPUTS + self.rows[-1])
        member = symbols >= OUTPUTS
        group = np.where(member, np.searchsorted(self.rows, symbols - OUTPUTS, "right") - 1, symbols - 1 - TOP_WORDS)
        output = np.where(member, 1 + TOP_WORDS + group, symbols)
        group = np.where((group < 0) | (group >= BUCKETS), -1, group)
        group[self.rows[group + 1] - self.rows[group] <= 1] = -1
        return output, group, np.where(group < 0, -1, np.where(member, symbols - OUTPUTS, self.rows[group]))

    def located(self, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """The output of each symbol, its group and its row there; group and row are -1 for end and top words
        and where a group has a rest only."""
        return tuple(x[symbols] for x in self._located)

    def log10(self, symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all symbols."""
        out = np.empty(len(symbols))
        run, places = padded(symbols, of)
        outputs, inner = _Outputs(self.targets), {}
        for start in range(0, len(symbols), SCORED_AT_ONCE):
            at = places[start : start + SCORED_AT_ONCE]
            output, group, row = self.located(run[at])
            hidden = self.hidden(run[at[0] - CONTEXT : at[-1] + 1])[1]
            if hidden.shape[1] > len(at):
                hidden = hidden.take(at - at[0], 1)
            logs = outputs.log_share(hidden, output)
            tail = np.flatnonzero(group >= 0)
            tail = tail[np.argsort(group[tail].astype(np.uint16), kind="stable")]
            hidden, row, group = hidden.take(tail, 1), row[tail], group[tail]
            borders = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                first, end = self.rows[group[a] : group[a] + 2].tolist()
                if first not in inner:
                    inner[first] = _Outputs(self.inner[first:end])
                logs[tail[a:b]] += inner[first].log_share(hidden[:, a:b], row[a:b] - first)
            out[start : start + len(at)] = logs
        return out / math.log(10)


def _row_logs(rows: np.ndarray, row_noise: np.ndarray) -> np.ndarray:
    """Logs of the share of each row in its group."""
    return np.log(row_noise / np.repeat(np.add.reduceat(row_noise, rows[:-1]), np.diff(rows))).astype(np.float32)


_BLOCK = np.arange(SCORED)


class _Outputs:
    """Some outputs, to tell shares among them."""

    def __init__(self, targets: np.ndarray) -> None:
        self.vectors, self.bias = np.ascontiguousarray(targets[:, :SIZE]), targets[:, SIZE]
        # within these bounds exponentials without and of the bias keep their digits
        self.apart = bool(np.abs(self.bias).max() < 40)
        self.weights = np.exp(np.clip(self.bias, -40, 40))

    def log_share(self, hidden: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log of the share of output ``at`` among all outputs, in blocks that stay in a core's cache."""
        out, sums, own = self.bias[at].astype(np.float64), np.empty(len(at), np.float32), np.empty(len(at), np.float32)
        room = np.empty(len(self.bias) * min(SCORED, len(at)), np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(0, len(at), SCORED):
                size = min(SCORED, len(at) - k)
                logits = room[: len(self.bias) * size].reshape(-1, size)
                np.matmul(self.vectors, np.ascontiguousarray(hidden[:SIZE, k : k + size]), out=logits)
                logits.take(at[k : k + SCORED] * size + _BLOCK[:size], out=own[k : k + SCORED], mode="clip")
                np.matmul(self.weights, np.exp(logits, out=logits), out=sums[k : k + SCORED])
        out += own
        fine = (sums > 1e-18) & (sums < 1e30)
        if self.apart and fine.all():
            return out - np.log(sums)
        for k in range(0, len(at), SCORED):
            logits = self.vectors.astype(np.float64) @ hidden[:SIZE, k : k + SCORED] + self.bias[:, None]
            top = logits.max(0)
            own = logits[at[k : k + SCORED], _BLOCK[: len(top)]]
            out[k : k + SCORED] = own - top - np.log(np.exp(logits - top).sum(0))
        return out


def _summed(at: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``at``, which are below ``most``, and the sums of their columns of ``values``, a row each."""
    there = np.zeros(most, bool)
    there[at] = True
    own = np.flatnonzero(there)
    size, place = len(values), np.empty(most, np.int64)
    place[own] = np.arange(0, size * len(own), size)
    index = np.add(place[at], np.arange(size)[:, None])
    return own, np.bincount(index.ravel(), values.ravel(), size * len(own)).reshape(-1, size)


def _noisy(against: np.ndarray) -> np.ndarray:
    """How likely each is data and not noise, from the logit of the contrary; in place."""
    np.minimum(against, 30, out=against)
    np.exp(against, out=against)
    against += 1
    return np.reciprocal(against, out=against)


class Trainer:
    """Noise-contrastive estimation with steps scaled as in Adagrad; only rows of the batch are touched."""

    def __init__(self, model: Model, known: Vocabulary, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        self.seen = [np.full(x.shape, 1e-3, np.float32) for x in model.trainable()]
        self.below = np.cumsum(known.noise / known.noise.sum())
        self.log_noise = np.log(NOISE * known.noise / known.noise.sum()).astype(np.float32)
        self.row_below = np.concatenate(([0], np.cumsum(known.row_noise)))
        self.row_log_noise = _row_logs(known.rows, known.row_noise) + np.float32(math.log(GROUP_NOISE))
        self.n = 0

    def learn(self, symbols: np.ndarray, of: np.ndarray) -> None:
        """Every position of some texts, in batches of short runs from random places."""
        if not len(symbols):
            return
        run, at = padded(symbols, of)
        count = -(-(len(run) - CONTEXT) // RUN)
        run = np.concatenate((run, np.zeros(count * RUN + CONTEXT - len(run), np.int64)))
        real = np.zeros(len(run), bool)
        real[at] = True
        places = self.rng.permutation(count)
        for some in np.array_split(places, max(1, round(count * RUN / BATCH))):
            place = some[:, None] * RUN + np.arange(RUN + CONTEXT)
            self.step(run[place], np.flatnonzero(real[place[:, CONTEXT:]]))

    def step(self, runs: np.ndarray, at: np.ndarray) -> None:
        """One batch: positions ``at`` of those after the first CONTEXT ones of every run.  All are held against
        the same NOISE symbols, and those of a group against the same GROUP_NOISE rows of it."""
        m, n = self.model, len(at)
        run, width = runs.ravel(), runs.shape[1] - CONTEXT
        at = at + at // width * CONTEXT
        output, group, row = m.located(run[at + CONTEXT])
        order = np.argsort(np.where(group < 0, output, OUTPUTS + group).astype(np.uint16), kind="stable")
        at, output, group, row = at[order], output[order], group[order], row[order]
        vectors, h = m.hidden(run)
        every, h = h.shape[1], h.take(at, 1)
        noise = np.minimum(np.searchsorted(self.below, self.rng.random(NOISE), "right"), OUTPUTS - 1)
        own, other = np.ascontiguousarray(m.targets.take(output, 0).T), m.targets.take(noise, 0)
        first = np.flatnonzero(np.concatenate(([True], output[1:] != output[:-1])))
        g_own = _noisy(self.log_noise[output] - (h * own).sum(0)) - 1
        against = -other
        against[:, SIZE] += self.log_noise[noise]  # the last row of what predicts is one
        g_other = _noisy(against @ h)
        d_h = other[:, :SIZE].T @ g_other
        d_h += np.multiply(own[:SIZE], g_own, out=own[:SIZE])
        pushed = np.add.reduceat(np.multiply(h, g_own, out=own), first, 1)
        moves = [(2, np.concatenate((output[first], noise)), np.concatenate((pushed, h @ g_other.T), 1))]
        tail = int(np.searchsorted(group, 0))
        if tail < n:
            group, row, first = group[tail:], row[tail:], first[first >= tail] - tail
            low, high = m.rows[group[first]][:, None], m.rows[group[first] + 1][:, None]
            share = self.rng.random((len(first), GROUP_NOISE))
            drawn = self.row_below[low] + (self.row_below[high] - self.row_below[low]) * share
            drawn = np.clip(np.searchsorted(self.row_below, drawn, "right") - 1, low, high - 1)
            h_tail, own = h[:, tail:], np.ascontiguousarray(m.inner.take(row, 0).T)
            g_own = _noisy(self.row_log_noise[row] - (h_tail * own).sum(0)) - 1
            d_h[:, tail:] += own[:SIZE] * g_own
            # groups in pieces of PIECE places, the last of a group filled up with zeros
            size = np.diff(first, append=n - tail)
            pieces = -(-size // PIECE)
            slot = np.arange(n - tail) + np.repeat(PIECE * (np.cumsum(pieces) - pieces) - first, size)
            drawn = np.repeat(drawn, pieces, 0)
            h_piece = np.zeros((len(drawn), PIECE, SIZE + 1), np.float32)
            h_piece.reshape(-1, SIZE + 1)[slot] = h_tail.T
            other = m.inner.take(drawn, 0)
            against = -other
            against[:, :, SIZE] += self.row_log_noise[drawn]
            g_other = _noisy(h_piece @ against.transpose(0, 2, 1))
            d_h[:, tail:] += (g_other @ other[:, :, :SIZE]).reshape(-1, SIZE).take(slot, 0).T
            pushed = (g_other.transpose(0, 2, 1) @ h_piece).reshape(-1, SIZE + 1)
            own = np.multiply(h_tail, g_own, out=own)
            moves.append((3, np.concatenate((row, drawn.ravel())), np.concatenate((own, pushed.T), 1)))
        d = np.zeros((SIZE, every), np.float32)
        d[:, at] = d_h
        d_runs, d_places, part = np.zeros_like(vectors), np.empty_like(m.places), np.empty_like(d)
        for k in range(CONTEXT):
            before = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + every)
            d_runs[:, before] += np.multiply(d, m.places[k][:, None], out=part)
            d_places[k] = np.vecdot(vectors[:, before], d)
        moves.append((0, run, d_runs))
        for k, places, d in moves:
            places, sums = _summed(places, d, len(m.trainable()[k]))
            self._move(k, places, (sums / n).astype(np.float32))
        self._move(1, np.arange(CONTEXT), d_places / n)
        self.n += n

    def _move(self, k: int, at: np.ndarray, d: np.ndarray) -> None:
        s, x = self.seen[k].take(at, 0), self.model.trainable()[k]
        s += d * d
        self.seen[k][at] = s
        np.divide(d, np.sqrt(s, out=s), out=s)
        s *= -RATE
        s += x.take(at, 0)
        x[at] = s


CODES = "row long, doc_id long, n_tokens long, known long, log_c double, rest double, symbols binary, rare array<string>, tf array<long>"


def codes(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """One row per row of ``docs``: its texts as 16-bit symbols, what its words of the vocabulary come to, and the
    distinct words outside it with their counts.  ``rest`` sums the shares of words within the rests of groups."""
    sent = shipped(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(sent)
        number = TaskContext.get().partitionId() << 40
        log_end = math.log10(known.ends + 1)
        for batch in batches:
            for first, texts in coded(batch.column("text"), known):
                words, n = texts.words, texts.words.n
                own_log = np.where(texts.inside, known.logs[texts.place], 0.0) if len(known.logs) else np.zeros(len(texts.place))
                text_of = words.text_of()
                symbols = texts.symbols[np.arange(len(text_of)) + text_of]
                other = ~texts.named
                group = known.group_logs[np.where(other, symbols, 0)]
                seen = reduced(np.add, texts.inside.astype(np.int64), words.of) + (known.ends > 0)
                rare = np.flatnonzero(~texts.inside)
                own, at, which = np.unique(texts.hashes[rare], return_index=True, return_inverse=True)
                pair, tf = np.unique(text_of[rare] * len(own) + which, return_counts=True)
                doc, which = (pair // len(own), pair % len(own)) if len(pair) else (pair, pair)
                ends = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                raw = pa.py_buffer((2 * texts.of).astype(np.int32)), pa.py_buffer(texts.symbols.astype("<u2"))
                columns = [
                    pa.array(number + np.arange(n)),
                    batch.column("doc_id").slice(first, n),
                    pa.array(words.counts() + 1, pa.int64()),
                    pa.array(seen, pa.int64()),
                    pa.array(reduced(np.add, own_log, words.of) + log_end),
                    pa.array(reduced(np.add, np.where(other, own_log - group, 0.0), words.of)),
                    pa.BinaryArray.from_buffers(pa.binary(), n, [None, *raw]),
                    pa.ListArray.from_arrays(ends, spelled(words, rare[at[which]])),
                    pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64())),
                ]
                number += n
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CODES.split(", ")])

    return _texts(docs).mapInArrow(run, CODES)


def symbols_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols, bounds of the texts) of slices of about CHUNK_SYMBOLS; a text is never cut."""
    _, offsets, values = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    of = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = np.frombuffer(values, np.uint8)[: 2 * of[-1]].view("<u2") if values is not None else np.zeros(0, "<u2")
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(of, of[at] + CHUNK_SYMBOLS, "right")) - 1)
        yield at, data[of[at] : of[to]].astype(np.int64), of[at : to + 1] - of[at]
        at = to


def trained(texts: DataFrame, known: Vocabulary) -> Model:
    """The model after ROUNDS rounds over the ``symbols`` of all texts; without texts, the start."""
    model = Model.start(known.noise, known.rows, known.row_noise)
    for turn in range(ROUNDS):
        sent = shipped(texts.sparkSession, (model.flat(), known))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            flat, known = opened(sent)
            part = TaskContext.get().partitionId()
            trainer = Trainer(Model.of(flat, known.rows), known, seed=part * ROUNDS + turn)
            for batch in batches:
                for _, symbols, of in symbols_of(batch.column("symbols")):
                    trainer.learn(symbols, of)
            yield _row(trainer.model.flat(), trainer.n)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(0), 0
            for batch in batches:
                for r in batch.to_pylist():
                    part = np.frombuffer(r["mean"], np.float32).astype(np.float64) * r["n"]
                    total, n = (total + part if len(total) else part), n + r["n"]
            yield _row(total / max(n, 1), n)

        parts = texts.select("symbols").mapInArrow(run, "mean binary, n long")
        # partial sums first: the driver gets about the square root of the number of partitions, one after the other
        few = max(1, math.isqrt(parts.rdd.getNumPartitions()))
        total, n = 0.0, 0
        for r in parts.repartition(few).mapInArrow(added, "mean binary, n long").toLocalIterator():
            if r.n:
                total, n = total + np.frombuffer(bytes(r.mean), np.float32).astype(np.float64) * r.n, n + r.n
        if n:
            model = Model.of(total / n, known.rows)
        sent.unpersist()
    return model


def _row(mean: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["mean", "n"]
    )


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per input row.

    Counts and model learn from the rows outside the held-out fold; a null id is never held out.  Null and
    empty texts are an end alone; repeated rows stay rows of their own.  Without training rows every word
    is unknown.  Other columns are not read.
    """
    rows = _texts(docs)
    fresh = held_out(F.col("doc_id"), MODULUS, REMAINDER)
    counts = stored(word_counts(rows.where(~fresh)))
    known = vocabulary(counts)
    texts = stored(codes(rows, known))
    sent = shipped(docs.sparkSession, trained(texts.where(~fresh), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(sent)
        for batch in batches:
            names = batch.column("row").to_numpy()
            neural = batch.column("rest").to_numpy().copy()
            for first, symbols, of in symbols_of(batch.column("symbols")):
                neural[first : first + len(of) - 1] += reduced(np.add, model.log10(symbols, of), of)
            yield _rows(
                names,
                batch.column("doc_id"),
                pa.array([f" {x}" for x in names.tolist()]),  # no word, and no frequent key
                n_tokens=batch.column("n_tokens"),
                known=batch.column("known"),
                log_c=batch.column("log_c"),
                neural=neural,
            )
            rare, tf = batch.column("rare"), batch.column("tf")
            some = np.repeat(names, rare.value_lengths().to_numpy())
            yield _rows(some, pa.nulls(len(some), pa.int64()), rare.flatten(), tf=tf.flatten())

    kinds = "row long, doc_id long, token string, tf long, n_tokens long, known long, log_c double, neural double"
    joined = texts.mapInArrow(run, kinds).join(counts, "token", "left")
    rare_log = F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1)
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("log_c") + rare_log).alias("log_c"),
        F.sum(F.col("neural") + rare_log).alias("score"),
    )
    below = math.log10(known.total + known.kinds + 1)
    return sums.select(
        "doc_id",
        fresh.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )


def _rows(row: np.ndarray, doc_id: pa.Array, token: pa.Array, **columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"tf": np.int64, "n_tokens": np.int64, "known": np.int64, "log_c": np.float64, "neural": np.float64}
    rest = [pa.array(np.asarray(columns.get(c, np.zeros(len(row))), kind)) for c, kind in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), doc_id, token, *rest], names=["row", "doc_id", "token", *kinds])
