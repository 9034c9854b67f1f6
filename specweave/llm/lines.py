"""Line deduplication: pairwise alignment of documents that share lines.

Every shortest run of lines with enough words leads a later document to the first document that holds
the run, so a run held by very many documents makes one link for each of them and not one for every
pair.  Linked documents are aligned as wholes by patience diff over their runs, in rounds; aligned blocks are
cut from the later one.
Each line of a common block is in a shortest run inside the block, so it has a partner that holds the run.
The first holder of a run never loses it, as no earlier document holds it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.tables import stored

MIN_WORDS = 10
ROUNDS = 32  # of alignment of one pair
_SIZE = 16  # bytes of a line's digest
_FLUSH = 20_000


def _longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest rising subsequence of distinct values."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k:
            before[i] = ends[k - 1]
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def patience(first: list, second: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: common ends, then what is unique in both in its longest
    common order, then the same between them; without anything unique, repeats count by their rank."""
    out = []
    todo = [(0, len(first), 0, len(second))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and first[a] == second[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and first[a_end - 1] == second[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        ones = {x for x, n in Counter(first[a:a_end]).items() if n == 1}
        ones &= {x for x, n in Counter(second[b:b_end]).items() if n == 1}
        if ones:
            at = {first[i]: i for i in range(a, a_end) if first[i] in ones}
            places = [(at[second[j]], j) for j in range(b, b_end) if second[j] in ones]
        else:  # the k-th of one is held against the k-th of the other
            named = {x: i for i, x in zip(range(a, a_end), _numbered(first[a:a_end]))}
            places = [(named[x], j) for j, x in zip(range(b, b_end), _numbered(second[b:b_end])) if x in named]
        if not places:
            continue
        for i, j in (places[k] for k in _longest_rising([i for i, _ in places])):
            out.append((i, j))
            todo.append((a, i, b, j))
            a, b = i + 1, j + 1
        todo.append((a, a_end, b, b_end))
    return sorted(out)


def _numbered(values: list) -> list[tuple]:
    """Each value with how often it stood before."""
    seen: Counter = Counter()
    out = []
    for x in values:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def common_lines(earlier: list, later: list, sizes: list[int], min_words: int) -> list[int]:
    """Positions in ``later`` of the blocks of at least ``min_words`` words that both sequences hold.

    The shortest runs with enough words that both hold are the units of the alignment.  What patience diff aligns
    is cut; the rest is aligned again, so that blocks in another order come out in a later round.  After ROUNDS
    rounds every run that is left is aligned alone, which finds the same.
    """
    size_of = dict(zip(later, sizes))
    first: list[tuple] = []
    for shared, piece in groupby(earlier, size_of.__contains__):
        if shared:
            own = list(piece)
            first += [tuple(own[i:j]) for i, j in _runs([size_of[x] for x in own], min_words)]
    held = set(first)
    left = [(run, i, j) for i, j in _runs(sizes, min_words) if (run := tuple(later[i:j])) in held]
    cut: set[int] = set()
    for turn in range(ROUNDS + 1):
        runs = [run for run, _, _ in left]
        if turn < ROUNDS:
            aligned = {k for _, k in patience(first, runs)}
        else:
            aligned = {k for k, run in enumerate(runs) if patience([run], [run])}
        for k in aligned:
            cut.update(range(*left[k][1:]))
        left = [x for k, x in enumerate(left) if k not in aligned and not cut.issuperset(range(*x[1:]))]
        if not left or not aligned:
            break
    return sorted(cut)


def _runs(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """Bounds of the runs with ``min_words`` words or more that lose them without their last line, or without
    their first one.  Every line of a block with ``min_words`` words is in such a run inside the block."""
    out = set()
    ends = [0, *accumulate(sizes)]
    for i, n in enumerate(ends[:-1]):
        j = bisect_left(ends, n + min_words, i + 1)
        if j < len(ends):
            out.add((i, j))
    for j, n in enumerate(ends[1:], 1):
        i = bisect_right(ends, n - min_words, 0, j) - 1
        if i >= 0:
            out.add((i, j))
    return sorted(out)


def _seeds(lines: list[bytes], sizes: list[int], min_words: int) -> list[bytes]:
    """Digests of the distinct runs of a document: a line's own, or that of its lines' digests."""
    runs = {b"".join(lines[i:j]) for i, j in _runs(sizes, min_words)}
    return sorted(x if len(x) == _SIZE else hashlib.blake2b(x, digest_size=_SIZE).digest() for x in runs)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _key(doc_id: Column, text: Column) -> Column:
    """Bytes in the order of documents: by id, null last, then by the text's digest."""
    order = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    order = F.coalesce(order, F.lit("F" * 18))
    return F.unhex(F.concat(order, F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def _lined(keyed: DataFrame) -> DataFrame:
    """``doc, lines, sizes``: digests and word counts of the lines that have words; equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = [], []
            for text in batch.column("text").to_pylist():
                words = [w for w in map(str.split, (text or "").split("\n")) if w]
                lines.append(b"".join(hashlib.blake2b(" ".join(w).encode(), digest_size=_SIZE).digest() for w in words))
                sizes.append(np.array([len(w) for w in words], "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(lines, pa.binary()), pa.array(sizes, pa.binary())], names=["doc", "lines", "sizes"]
            )

    return keyed.mapInArrow(run, "doc binary, lines binary, sizes binary").dropDuplicates(["doc"])


def _split(lines: bytes) -> list[bytes]:
    return [lines[i : i + _SIZE] for i in range(0, len(lines), _SIZE)]


def _cuts(lined: DataFrame, min_words: int) -> DataFrame:
    """``doc, cut``: the positions, among its lines with words, that a document loses."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(runs: list[bytes], docs: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), pa.array(docs, pa.binary())], names=["run", "doc"])

        runs: list[bytes] = []
        docs: list[bytes] = []
        for batch in batches:
            for doc, raw, sizes in zip(*(batch.column(c).to_pylist() for c in ("doc", "lines", "sizes"))):
                own = _seeds(_split(raw), np.frombuffer(sizes, "<u4").tolist(), min_words)
                runs += own
                docs += [doc] * len(own)
                if len(runs) >= _FLUSH:
                    yield made(runs, docs)
                    runs, docs = [], []
        yield made(runs, docs)

    seeds = stored(lined.mapInArrow(exploded, "run binary, doc binary"))
    firsts = seeds.groupBy("run").agg(F.min("doc").alias("before"), F.max("doc").alias("last")).where("before <> last")
    # as a table of its own, so that adaptive execution can split a run that very many documents hold
    firsts = stored(firsts.select("run", "before"))
    pairs = seeds.join(firsts, "run").where("doc <> before").select("doc", "before").distinct()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, cuts = [], []
            columns = (batch.column(c).to_pylist() for c in ("doc", "lines", "sizes", "before_lines"))
            for doc, lines, sizes, before in zip(*columns):
                counts = np.frombuffer(sizes, "<u4").tolist()
                cut = common_lines(_split(before), _split(lines), counts, min_words)
                if cut:
                    docs.append(doc)
                    cuts.append(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))], names=["doc", "cut"]
            )

    before = lined.select(F.col("doc").alias("before"), F.col("lines").alias("before_lines"))
    both = pairs.join(before, "before").join(lined, "doc").select("doc", "lines", "sizes", "before_lines")
    found = both.mapInArrow(align, "doc binary, cut array<int>")
    # one list for each partner, and a document has at most two partners for each of its lines
    return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_cut, text``: one row per input row, its text without the blocks of lines that
    an earlier document holds too.

    Lines are cut at line feeds and compared by their words, so spacing does not count; lines without
    words belong to no block and stay.  A block is a run of lines in both documents with ``min_words``
    words or more.  Documents come in the order of their ids, those without id last; rows of one id are
    ordered by a digest of their texts, and rows equal in both are one document.  A null text stays null
    and has no lines.  Other columns are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = "doc_id long, text string, n_lines int, n_cut int"
    return _rewritten(named, min_words, counted).select("doc_id", "n_lines", "n_cut", "text")



def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all its columns and the texts of :func:`without_repeats`.

    Documents of which no line with words is left are left out; those that had none stay.
    """
    return _rewritten(docs, min_words, None)


def _rewritten(docs: DataFrame, min_words: int, counted: str | None) -> DataFrame:
    names = docs.columns
    key, cut_name = _free("doc_key", names), _free("doc_cut", names)
    text_at = [n.lower() for n in names].index("text")
    lined = stored(_lined(docs.select(_key(F.col("doc_id"), F.col("text")).alias("doc"), F.col("text").cast("string").alias("text"))))
    cuts = _cuts(lined, min_words).toDF(key, cut_name)
    keyed = docs.withColumn(key, _key(F.col("doc_id"), F.col("text"))).join(cuts, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(text_at).to_pylist(), batch.column(cut_name).to_pylist()
            n_lines = np.zeros(len(texts), np.int32)
            n_cut = np.zeros(len(texts), np.int32)
            for d, (text, cut) in enumerate(zip(texts, cuts)):
                lines = [] if text is None else text.split("\n")
                n_lines[d] = len(lines)
                if cut:
                    gone, at, kept = set(cut), 0, []
                    for line in lines:
                        has_words = bool(line.split())
                        if not (has_words and at in gone):
                            kept.append(line)
                        at += has_words
                    texts[d], n_cut[d] = "\n".join(kept), len(gone)
            columns = [batch.column(i) for i in range(len(names))]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if counted:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_cut)], names=[*names, "n_lines", "n_cut"])
            else:
                left = [not n or bool(t.strip()) for n, t in zip(n_cut.tolist(), texts)]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(left, pa.bool_()))

    return keyed.mapInArrow(run, counted or docs.schema)
