"""Exact cosine top-k between two sets of vectors.

The angle between vectors is a metric, so entries are grouped around anchor
vectors (cells) and a query visits only the cells that the triangle inequality
cannot rule out for its search radius.  Cells are cut into blocks, a row each, and a
task pairs a part of the queries' blocks with a part of the entries': both are shuffled
once, whatever the number of pairs, and no cell, however full, becomes one task.  The idea
is the metric-space similarity join of Das Sarma, He and Chaudhuri (VLDB 2014).

A block of a query's own cell is searched first: its ``limit``-th best there bounds how far the
query looks.  Before the full product of a pair, the leading coordinates in a basis
that the anchors span, and the lengths of what is left, bound it from above.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave import model as M
from specweave.functions.similarity import matrix_of
from specweave.operators.blocks import Best, crossed, dealt, spread
from specweave.sources.tables import small_table

_DIGITS = 9         # similarities are compared at nine decimals, equal ones by id
# Widening of angles against rounding: arccos is steep near 1, where an error of 1e-9 in
# the cosine moves the angle by up to 4.5e-5.
_SLACK = 1e-4
_LEAD = 16          # leading coordinates of the bound
_HAIR = 1e-8        # widening of that bound
_FEW = 0.25         # share of a block's pairs up to which they are multiplied one by one
_HELD = 64 << 20    # bytes of entries that a task holds


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays as a built-in expression (for few pairs)."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda s, x: s + x,
    )

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * norm(b))


def _anchors(entries: DataFrame, count: int, dim: int | None) -> np.ndarray:
    """One entry from each of ``count`` hash buckets, as unit vectors on the driver: as many as
    the caller asks for, and nothing else."""
    ids = entries.select("entry_id")
    picked = ids.groupBy(F.pmod(F.xxhash64("entry_id"), F.lit(count))).agg(
        F.max_by("entry_id", F.xxhash64("entry_id", F.lit(1))).alias("entry_id")
    )
    # at most `count` short rows to broadcast, and `count` vectors to collect
    rows = (
        entries.join(F.broadcast(picked.select("entry_id")), "entry_id", "left_semi")
        .select("embedding").toArrow().column("embedding")
    )
    if dim is None:
        sizes = Counter(len(v) for v in rows.to_pylist() if v)
        dim = sizes.most_common(1)[0][0] if sizes else 0
    units, good = matrix_of(rows, dim)
    return np.unique(units[good], axis=0)


def _basis(anchors: np.ndarray) -> np.ndarray:
    """Orthonormal directions in which the anchors are long, as columns."""
    return np.linalg.svd(anchors, full_matrices=False)[2][:_LEAD].T


def _led(units: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors, then the length of the rest."""
    lead = units @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - (lead**2).sum(axis=1)))
    return np.hstack([lead, rest[:, None]])


def _placed(rows: DataFrame, anchors: np.ndarray, cells: np.ndarray) -> DataFrame:
    """(id, unit, cell, angle): the nearest of the anchors ``cells``; unusable vectors are dropped."""
    dim = anchors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, good = matrix_of(batch.column("embedding"), dim)
            units = units[good]
            cosines = np.clip(units @ anchors[cells].T, -1.0, 1.0)
            near = cosines.argmax(axis=1) if len(cosines) else np.zeros(0, dtype=np.int64)
            angles = np.arccos(cosines[np.arange(len(near)), near])
            raw = pa.array([u.tobytes() for u in units], pa.binary())
            kept = batch.column("id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept, raw, pa.array(cells[near].astype(np.int32)), pa.array(angles)], ["id", "unit", "cell", "angle"]
            )

    return rows.mapInArrow(run, "id string, unit binary, cell int, angle double")


_BLOCK = "cell int, part int, ids array<string>, units binary"


def _packed(key, rows):
    """The rows of a block as one row, by id."""
    ids = rows.column("id").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    units = rows.column("unit").to_pylist()
    return pa.table(
        {
            "cell": pa.array([key[0].as_py()], pa.int32()),
            "part": pa.array([key[1].as_py()], pa.int32()),
            "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.string())),
            "units": pa.array([b"".join(units[i] for i in order)], pa.binary()),
        }
    )


def _in_blocks(placed: DataFrame, sizes: list[tuple[int, int]], block_rows: int) -> tuple[DataFrame, int]:
    """A row for every block of about ``block_rows`` rows of one cell, and how many there are at most."""
    parts = [(cell, -(-n // block_rows)) for cell, n in sizes]
    blocks = dealt(placed, "id", parts).groupBy("cell", "part").applyInArrow(_packed, _BLOCK)
    return blocks, sum(n for _, n in parts)


def _exact(q: np.ndarray, e: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        i, j = rows[at : at + (1 << 16)], columns[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", q[i], e[j])
    return np.round(out, _DIGITS)


class _Asked:
    """The queries of a block, and the best entries that they have met."""

    def __init__(self, ids: list[str], units: bytes, low: np.ndarray, limit: int, anchors: np.ndarray, rings: np.ndarray, floor: float):
        self.ids, self.units = ids, np.frombuffer(units).reshape(-1, anchors.shape[1])
        self.short = self.units.astype(np.float32)
        self.low, self.limit, self.floor = low.copy(), limit, floor
        self.basis = _basis(anchors)
        self.lead = _led(self.units, self.basis)
        self.rings, self.reach = rings, _reach(self.units, low, anchors, rings)
        self.tried = self.shut = 0
        # single precision errs by less than this
        self.hair = (anchors.shape[1] + 8) * 1.2e-7
        self.found = Best(len(ids), limit)

    def visitors(self, cell: int) -> np.ndarray:
        return np.flatnonzero(self.reach[:, self.rings[:, 0] == cell].any(axis=1))

    def open(self, at: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The pairs whose bound reaches the query's least similarity."""
        # q.e <= leading parts' product + product of the lengths of the rests
        return self.lead[at] @ _led(units, self.basis).T >= self.low[at][:, None] - _HAIR

    def _candidates(self, at: np.ndarray, units: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.tried < 4 or 2 * self.shut > self.tried:
            pairs = self.open(at, units)
            few = pairs.mean() <= _FEW
            self.tried, self.shut = self.tried + 1, self.shut + few
            if few:
                return np.nonzero(pairs)
        near = self.short[at] @ short.T
        least = self.low[at]
        mask = near >= (least - self.hair).astype(np.float32)[:, None]
        if mask.sum() > 4 * self.limit * len(at):
            k = near.shape[1] - self.limit
            least = np.partition(near, k, axis=1)[:, k] - 2 * self.hair
            mask &= near >= least.astype(np.float32)[:, None]
        return np.nonzero(mask)

    def meet(self, cell: int, names: np.ndarray, units: np.ndarray) -> None:
        at_all = self.visitors(cell)
        short = units.astype(np.float32)
        for first in range(0, len(at_all), 256):
            at = at_all[first : first + 256]
            i, j = self._candidates(at, units, short)
            sims = _exact(self.units, units, at[i], j)
            good = (sims >= self.floor) & (sims >= self.low[at[i]])
            self.found.add(at[i][good], sims[good], names[j[good]])
        if self.found.many():
            self.settle()

    def settle(self) -> None:
        rows, worst = self.found.settle()
        self.low[rows] = np.maximum(self.low[rows], worst - _HAIR)

    def best(self) -> pa.RecordBatch:
        self.settle()
        asked = pa.array([self.ids[i] for i in self.found.rows], pa.string())
        columns = [asked, pa.array(self.found.names, pa.string()), pa.array(self.found.scores)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "entry_id", "similarity"])


def _reach(units: np.ndarray, low: np.ndarray, anchors: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """Which cells may hold an entry at ``low`` or above, for each query.

    rings: one row (cell, smallest angle, largest angle) per cell that holds entries.
    """
    angles = np.arccos(np.clip(units @ anchors.T, -1.0, 1.0))
    r = np.arccos(np.clip(low, -1.0, 1.0))[:, None] + _SLACK
    own = angles[:, rings[:, 0].astype(np.int32)]
    reach = (own - r <= rings[:, 2]) & (own + r >= rings[:, 1])
    return reach & (own <= angles.min(axis=1, initial=np.inf)[:, None] + 2 * r)


class _Search:
    """Entries and queries in blocks of one cell each."""

    def __init__(self, queries, entries, limit, floor, anchors, dim, block_rows, keep):
        self.limit, self.floor, self.block_rows, self.keep = limit, -2.0 if floor is None else floor, block_rows, keep
        self.queries = queries.select(F.col("query_id").cast("string").alias("id"), "embedding")
        copies = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("entry_id")
        entries = (
            # of many copies of one vector only the first `limit` ids can be chosen
            entries.select(F.col("entry_id").cast("string").alias("entry_id"), "embedding")
            .withColumn("copy", F.row_number().over(copies))
            .where(F.col("copy") <= limit)
            .drop("copy")
        )
        self.centers = _anchors(entries, anchors, dim)
        if len(self.centers):
            rows = entries.select(F.col("entry_id").alias("id"), "embedding")
            placed = keep(_placed(rows, self.centers, np.arange(len(self.centers))))
            # one short row per anchor
            extent = placed.groupBy("cell").agg(
                F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")
            ).collect()
            self.rings = np.array([(r["cell"], r["lo"], r["hi"]) for r in extent], dtype=np.float64)
            blocks, n_blocks = _in_blocks(placed, [(r["cell"], r["n"]) for r in extent], block_rows)
            # shuffled once, read by every task that holds a part of the queries
            self.entries = spread(blocks, n_blocks, max(1, _HELD // (block_rows * self.centers.shape[1] * 8)))

    def asked(self) -> tuple[DataFrame, int]:
        """Blocks of queries (and their number) with the least similarity that can still count: the floor, or the ``limit``-th best
        among the first block of their own cell; and the cells that any of them reaches."""
        placed = self.keep(_placed(self.queries, self.centers, self.rings[:, 0].astype(np.int64)))
        sizes = [tuple(r) for r in placed.groupBy("cell").count().collect()]  # one short row per anchor
        blocks, n_blocks = _in_blocks(placed, sizes, self.block_rows)
        # at most one block for an anchor
        home = F.broadcast(self.entries.where("part = 0").select("cell", F.col("units").alias("home")))
        limit, floor, centers, rings = self.limit, self.floor, self.centers, self.rings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lows, cells = [], []
                for units, near in zip(batch.column("units").to_pylist(), batch.column("home").to_pylist()):
                    q = np.frombuffer(units).reshape(-1, centers.shape[1])
                    low = np.full(len(q), floor)
                    e = np.frombuffer(near or b"").reshape(-1, centers.shape[1])
                    if len(e) >= limit:
                        for at in range(0, len(q), 256):
                            sims = q[at : at + 256] @ e.T
                            worst = np.partition(sims, len(e) - limit, axis=1)[:, len(e) - limit]
                            low[at : at + 256] = np.maximum(floor, worst - _HAIR)
                    lows.append(low.tobytes())
                    cells.append(rings[_reach(q, low, centers, rings).any(axis=0), 0].astype(np.int32))
                kept = [batch.column(c) for c in ("cell", "part", "ids", "units")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lows, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], _ASKED
                )

        left = blocks.join(home, "cell", "left").mapInArrow(run, f"{_BLOCK}, low binary, cells array<int>")
        return left.select(*(F.col(c).alias(f"q_{c}") for c in _ASKED)), n_blocks

    def met(self) -> DataFrame:
        return crossed(*self.asked(), self.entries)


_ASKED = ["cell", "part", "ids", "units", "low", "cells"]
_FOUND = "query_id string, entry_id string, similarity double"


def _block_pairs(batches: Iterator[pa.RecordBatch], ask: Callable) -> Iterator[tuple[_Asked, bool, int, np.ndarray, np.ndarray]]:
    """(queries, whether they are others than before, cell, ids and vectors of entries) for every pair of blocks."""
    now, held = None, None
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            key = (columns["q_cell"][i].as_py(), columns["q_part"][i].as_py())
            other = key != now
            if other:
                low = np.frombuffer(columns["q_low"][i].as_py())
                now, held = key, ask(columns["q_ids"][i].as_py(), columns["q_units"][i].as_py(), low)
            names = columns["ids"][i].values.to_numpy(zero_copy_only=False)
            units = np.frombuffer(columns["units"][i].as_py()).reshape(len(names), -1)
            yield held, other, columns["cell"][i].as_py(), names, units


def _asker(search: _Search) -> Callable[[list, bytes, np.ndarray], _Asked]:
    limit, centers, rings, floor = search.limit, search.centers, search.rings, search.floor
    return lambda ids, units, low: _Asked(ids, units, low, limit, centers, rings, floor)


def _finder(search: _Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ask = _asker(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for held, other, cell, names, units in _block_pairs(batches, ask):
            if other and last is not None:
                yield last.best()
            held.meet(cell, names, units)
            last = held
        if last is not None:
            yield last.best()

    return run


def _counter(search: _Search) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of blocks, and those that need the full product."""
    ask = _asker(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = compared = 0
        for held, _, cell, _, units in _block_pairs(batches, ask):
            at = held.visitors(cell)
            met += len(at) * len(units)
            compared += int(held.open(at, units).sum())
        yield pa.RecordBatch.from_arrays([pa.array([met], pa.int64()), pa.array([compared], pa.int64())], ["n_met", "n_compared"])

    return run


def vector_topk(
    queries: DataFrame,
    entries: DataFrame,
    limit: int,
    floor: float | None = None,
    anchors: int = 16,
    dim: int | None = None,
    block_rows: int = 2048,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """The ``limit`` nearest entries per query, of those with similarity >= ``floor``.

    queries(query_id, embedding), entries(entry_id, embedding) ->
    (query_id, entry_id, similarity, vector_rank).  Ids are text; equal similarities go
    to the lower entry_id.  Zero vectors and vectors of another size find nothing.
    A first pass over a block of each query's own cell bounds its radius.  ``anchors`` should grow like
    the square root of the number of entries.  ``keep`` (for instance ``session.cut_lineage``)
    is applied to entries and queries once they have their cell.
    """
    search = _Search(queries, entries, limit, floor, anchors, dim, block_rows, keep)
    if not len(search.centers):
        return small_table(queries.sparkSession, [], _FOUND).withColumn("vector_rank", F.lit(1))
    hits = search.met().mapInArrow(_finder(search), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    return hits.withColumn("vector_rank", F.row_number().over(order)).where(F.col("vector_rank") <= limit)


def vector_effort(
    queries: DataFrame,
    entries: DataFrame,
    limit: int,
    floor: float | None = None,
    anchors: int = 16,
    dim: int | None = None,
    block_rows: int = 2048,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """(n_met, n_compared): pairs whose cells meet in :func:`vector_topk` after the first pass, and
    those of them that need the full product."""
    search = _Search(queries, entries, limit, floor, anchors, dim, block_rows, keep)
    schema = "n_met long, n_compared long"
    if not len(search.centers):
        return small_table(queries.sparkSession, [(0, 0)], schema)
    counted = search.met().mapInArrow(_counter(search), schema)
    return counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_met", "n_compared")))


def vector_topk_columns(
    queries: DataFrame,
    column_vectors: DataFrame,
    catalog: DataFrame,
    limit: int,
    floor: float = M.PREFILTER_FLOOR,
    **options,
) -> DataFrame:
    """(query_id, column_id, similarity, vector_rank) over column descriptions."""
    known = column_vectors.join(catalog.select("column_id"), "column_id", "left_semi")
    entries = known.select(F.col("column_id").alias("entry_id"), "embedding")
    found = vector_topk(queries, entries, limit, floor, **options)
    return found.withColumnRenamed("entry_id", "column_id")


def vector_topk_glossary(
    queries: DataFrame,
    term_vectors: DataFrame,
    terms: DataFrame,
    catalog: DataFrame,
    limit: int,
    floor: float = M.PREFILTER_FLOOR,
    **options,
) -> DataFrame:
    """(query_id, term_id, column_id, similarity, vector_rank): linked terms only.

    The neighbours are counted before the link is followed, so a link that leads to no
    catalog column uses up a place, as in a search followed by a lookup.
    """
    linked = terms.where("linked_column_id is not null").select("term_id", "linked_column_id")
    entries = term_vectors.join(linked, "term_id").select(
        F.col("term_id").alias("entry_id"), "embedding"
    )
    found = vector_topk(queries, entries, limit, floor, **options)
    return (
        found.withColumnRenamed("entry_id", "term_id")
        .join(linked, "term_id")
        .withColumnRenamed("linked_column_id", "column_id")
        .join(catalog.select("column_id"), "column_id", "left_semi")
        .select("query_id", "term_id", "column_id", "similarity", "vector_rank")
    )


def self_similarity_check(vectors: DataFrame, neighbours: int = 3, **options) -> DataFrame:
    """Every stored vector against all: its nearest entries and whether it is its own first.

    (entry_id, n_neighbours, own_distance, passed); a vector that has an exact copy passes
    when its own distance is zero, whichever copy is listed first.
    """
    found = vector_topk(
        vectors.select(F.col("entry_id").alias("query_id"), "embedding"),
        vectors, neighbours, None, **options,
    )
    top = F.max(F.when(F.col("vector_rank") == 1, F.col("similarity")))
    return found.groupBy(F.col("query_id").alias("entry_id")).agg(
        F.count("*").alias("n_neighbours"),
        F.round(1 - top, 4).alias("own_distance"),
        (F.round(1 - top, 4) == 0).alias("passed"),
        F.max(F.when(F.col("vector_rank") == 1, F.col("entry_id"))).alias("first_id"),
    )
