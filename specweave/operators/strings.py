"""String similarity: pair scores and exact top-k over a name dictionary."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.letters import band, first_of, reach
from specweave.functions.similarity import LetterSets, NameBlock, common, indel_ratio, indel_ratio_of
from specweave.functions.text import token_sort
from specweave.operators.blocks import Best, crossed, dealt, spread

Rows = Iterator[pa.RecordBatch]
Keep = Callable[[DataFrame], DataFrame]

_HELD = 256  # blocks of the dictionary that a task holds


def token_sort_similarity(left: Column, right: Column) -> Column:
    """0–1 at four decimals; blanks separate tokens, case and ``_`` count."""
    return indel_ratio(token_sort(left), token_sort(right))


_LEFT = "form string, cut double, cell int, low int, high int"
_RIGHT = "hit string, first_id string, cell int"
_FOUND = "form string, hit string, raw double, score double, first_id string"


def _banded(batches: Rows) -> Rows:
    """Each name with the band of its length."""
    for batch in batches:
        cells = pa.array([band(len(x)) for x in batch.column("hit").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["hit", "first_id", "cell"])


def _asked(cut: float, top_k: int) -> Callable[[Rows], Rows]:
    """Each asked name with its cut, the band of its length, and the bands of its partners.

    Names arrive sorted, together with those of the dictionary.  The ``top_k``-th best of the neighbours in
    that order is a score the answer cannot stay below, so it is the name's own cut.
    """

    def run(batches: Rows) -> Rows:
        for batch in batches:
            names, owned = batch.column("name").to_pylist(), batch.column("owned").to_pylist()
            held = [i for i, own in enumerate(owned) if own]
            out: list[tuple] = []
            for i, name in enumerate(names):
                if owned[i]:
                    continue
                at = bisect_left(held, i)
                near = [indel_ratio_of(name, names[j]) for j in held[max(0, at - top_k) : at + top_k]]
                own = max(cut, sorted(near)[-top_k]) if len(near) >= top_k else cut
                low, high = reach(len(name), own)
                out.append((name, own, band(len(name)), band(low), band(high)))
            yield _batch(out, _LEFT)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


class _Asked:
    """The names asked for in a block, and the best that they have met."""

    def __init__(self, rows: list[dict], top_k: int):
        self.forms = [r["form"] for r in rows]
        self.cuts = np.array([r["cut"] for r in rows])
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        self.sets = LetterSets(self.forms)
        self.found = Best(len(rows), top_k)

    def near(self, cell: int, sets: LetterSets) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share letters enough to reach the cut."""
        visit = np.flatnonzero((self.low <= cell) & (cell <= self.high))
        left, right = common(self.sets, sets)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for first in range(0, len(visit), 256):
            at = visit[first : first + 256]
            cuts = self.cuts[at].astype(np.float32)[:, None] * np.float32(1 - 1e-6)  # a hair less than they are
            least = cuts * (self.sets.lengths[at].astype(np.float32)[:, None] + sets.lengths.astype(np.float32)) - np.float32(1e-6)
            i, j = np.nonzero(2 * (left[at] @ right) >= least)
            parts.append((at[i], j))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def meet(self, cell: int, rows: list[dict]) -> None:
        names = [r["hit"] for r in rows]
        sets = LetterSets(names)
        i, j = self.near(cell, sets)
        if not len(i):
            return
        block = NameBlock(names)
        held = np.empty(len(rows), object)
        held[:] = [(r["first_id"], r["hit"]) for r in rows]
        score = 2.0 * block.lcs_pairs(block.rows(self.forms), i, j) / (self.sets.lengths[i] + sets.lengths[j])
        good = score >= self.cuts[i]
        self.found.add(i[good], score[good], held[j[good]])
        if self.found.many():
            at, worst = self.found.settle()
            self.cuts[at] = np.maximum(self.cuts[at], worst)

    def best(self) -> pa.RecordBatch:
        self.found.settle()
        rows, raw, names = self.found.rows, self.found.scores.tolist(), self.found.names
        return _batch([(self.forms[i], hit, x, round(x, 4), key) for i, x, (key, hit) in zip(rows, raw, names)], _FOUND)


def _block_pairs(batches: Rows, top_k: int) -> Iterator[tuple[_Asked, bool, int, list[dict]]]:
    """(names asked for, whether they are others than before, band, names of the dictionary) for every pair of blocks."""
    now, held = None, None
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            key = (columns["q_cell"][i].as_py(), columns["q_part"][i].as_py())
            other = key != now
            if other:
                now, held = key, _Asked(columns["q_rows"][i].as_py(), top_k)
            yield held, other, columns["cell"][i].as_py(), columns["rows"][i].as_py()


def _finder(top_k: int) -> Callable[[Rows], Rows]:
    def run(batches: Rows) -> Rows:
        last = None
        for held, other, cell, rows in _block_pairs(batches, top_k):
            if other and last is not None:
                yield last.best()
            held.meet(cell, rows)
            last = held
        if last is not None:
            yield last.best()

    return run


def _counter(top_k: int) -> Callable[[Rows], Rows]:
    """How many pairs are compared letter by letter, were no cut raised on the way."""

    def run(batches: Rows) -> Rows:
        n = sum(len(held.near(cell, LetterSets([r["hit"] for r in rows]))[0]) for held, _, cell, rows in _block_pairs(batches, top_k))
        yield _batch([(n,)], "n long")

    return run


def _wanted(names: DataFrame) -> DataFrame:
    # Blank names drop out after distinct(): a filter on the form would be pushed below
    # and sort the tokens of every row.
    wanted = names.select("eng_name").where("eng_name is not null").distinct()
    return wanted.withColumn("form", token_sort(F.col("eng_name")))


def _owners(catalog: DataFrame, top_k: int) -> DataFrame:
    """Columns by form; more than ``top_k`` of one form can never all be chosen."""
    forms = catalog.select("column_id", token_sort(F.col("column_name")).alias("hit"))
    n = F.row_number().over(Window.partitionBy("hit").orderBy("column_id"))
    return forms.withColumn("n", n).where(F.col("n") <= top_k)


def _in_blocks(rows: DataFrame, row_id: str, block_rows: int) -> tuple[DataFrame, int]:
    """A row for every block of one band, and how many there are at most; blocks of long names have fewer."""
    sizes = rows.groupBy("cell").count().collect()  # one short row per band
    parts = [(r["cell"], max(1, -(-r["count"] * max(1, first_of(r["cell"]) // 64) // block_rows))) for r in sizes]
    columns = [row_id, *(c for c in rows.columns if c not in (row_id, "cell"))]
    blocks = dealt(rows, row_id, parts).groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    return blocks, sum(n for _, n in parts)


def _pairs(wanted: DataFrame, owners: DataFrame, top_k: int, cut: float, block_rows: int, keep: Keep) -> DataFrame:
    """Blocks of names asked for beside the blocks of the dictionary that they may find partners in."""
    dictionary = owners.where("n = 1 and length(hit) > 0").select("hit", F.col("column_id").alias("first_id"))
    asked = wanted.where("length(form) > 0").select(F.col("form").alias("name"), F.lit(False).alias("owned")).distinct()
    both = asked.unionByName(dictionary.select(F.col("hit").alias("name"), F.lit(True).alias("owned")))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data, much work
    ordered = both.repartitionByRange(n, "name").sortWithinPartitions("name", "owned")
    left, n_left = _in_blocks(keep(ordered.mapInArrow(_asked(cut, top_k), _LEFT)), "form", block_rows)
    right, n_right = _in_blocks(keep(dictionary.mapInArrow(_banded, _RIGHT)), "hit", block_rows)
    bands = F.transform("rows", lambda r: F.sequence(r["low"], r["high"]))
    left = left.select(
        F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("rows").alias("q_rows"),
        F.array_distinct(F.flatten(bands)).alias("q_cells"),
    )
    return crossed(left, n_left, spread(right, n_right, _HELD))


def fuzzy_topk(
    names: DataFrame,
    catalog: DataFrame,
    top_k: int = M.BASE_TOP_K,
    cut: float = M.STRING_CUT,
    block_rows: int = 2048,
    keep: Keep = lambda df: df,
) -> DataFrame:
    """Best ``top_k`` catalog columns per distinct name with similarity >= ``cut``.

    names(eng_name), catalog(column_id, column_name) ->
    (eng_name, column_id, score, string_rank).  Work runs over distinct token-sorted forms.

    A name's neighbours in sorted order give it a cut of its own, at least ``cut``, which rises with what it finds.
    Blocks of names meet by the bands of lengths that the cut leaves open.  What a pair shares of its letters, a
    product of two matrices for a pair of blocks, leaves it out before the LCS.  All bounds lose
    nothing.  Ties go to the lower column_id.
    Two small actions run here: names are counted by band of length.  ``keep`` (``session.shared``) is
    applied to what is read more than once: the dictionary and both sides before they are cut into blocks.
    """
    wanted, owners = _wanted(names), keep(_owners(catalog, top_k))
    hits = _pairs(wanted, owners, top_k, cut, block_rows, keep).mapInArrow(_finder(top_k), _FOUND)
    by_form = Window.partitionBy("form").orderBy(F.desc("raw"), "first_id")
    chosen = hits.withColumn("r", F.row_number().over(by_form)).where(F.col("r") <= top_k)
    by_column = Window.partitionBy("form").orderBy(F.desc("raw"), "column_id")
    ranked_ = (
        chosen.join(owners, "hit")
        .withColumn("string_rank", F.row_number().over(by_column))
        .where(F.col("string_rank") <= top_k)
        .select("form", "column_id", "score", "string_rank")
    )
    return wanted.join(ranked_, "form").select("eng_name", "column_id", "score", "string_rank")


def fuzzy_effort(
    names: DataFrame,
    catalog: DataFrame,
    top_k: int = M.BASE_TOP_K,
    cut: float = M.STRING_CUT,
    block_rows: int = 2048,
    keep: Keep = lambda df: df,
) -> DataFrame:
    """(n_forms, n_hits, n_compared): distinct forms of both sides, and the pairs :func:`fuzzy_topk` compares."""
    wanted, owners = _wanted(names), keep(_owners(catalog, top_k))
    compared = _pairs(wanted, owners, top_k, cut, block_rows, keep).mapInArrow(_counter(top_k), "n long")
    forms = wanted.select("form").distinct().agg(F.count("*").alias("n_forms"))
    hits = owners.where("n = 1").agg(F.count("*").alias("n_hits"))
    total = compared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_compared"))
    one = F.lit(1).alias("one")
    return forms.withColumn("one", one).join(hits.withColumn("one", one), "one").join(total.withColumn("one", one), "one").drop("one")
