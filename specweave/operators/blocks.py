"""Similarity joins as pairs of blocks.

Both sides arrive with a ``cell``; a row of one side meets whole cells of the other.  A cell with many
rows is cut into parts by a hash of the row id, and each part becomes one row, a block.  A task reads a
part of either side's blocks and pairs them: both sides are shuffled once, however many pairs there are
and however hot a cell is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.functions.similarity import rank_of
from specweave.sources.tables import small_table

SPREAD = 8  # parts of the right side; a row of the left has at most ``limit`` hits in each


def dealt(rows: DataFrame, row_id: str, parts: list[tuple[int, int]]) -> DataFrame:
    """Rows with the ``part`` of their cell; parts: (cell, number of parts), as few rows as there are cells."""
    grid = F.broadcast(small_table(rows.sparkSession, parts, "cell int, parts int"))
    part = F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int")
    return rows.join(grid, "cell").withColumn("part", part).drop("parts")


def spread(blocks: DataFrame, n_blocks: int, held: int) -> DataFrame:
    """Blocks of the right side in SPREAD parts, or more, so that none has more than about ``held`` blocks."""
    return blocks.repartition(max(1, min(SPREAD, -(-n_blocks // 2)), -(-n_blocks // held)))


def crossed(left: DataFrame, n_blocks: int, right: DataFrame) -> DataFrame:
    """Each block of the left beside those of the right whose ``cell`` is in its ``q_cells``; the left's one after another."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(max(1, min(n, n_blocks)))
    return left.join(right.hint("shuffle_replicate_nl"), F.array_contains("q_cells", F.col("cell")))


class Best:
    """The ``limit`` best so far for each row of a block: by score, equal ones by name."""

    def __init__(self, n_rows: int, limit: int):
        self.n_rows, self.limit = n_rows, limit
        self.rows, self.scores, self.names = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_pending = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        if len(rows):
            self.pending.append((rows, scores, names))
            self.n_pending += len(rows)

    def many(self) -> bool:
        return 2 * self.n_pending > self.n_rows * self.limit

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Drop what cannot be among the best; the rows that have ``limit``, and the least score of each."""
        rows, scores, names = (np.concatenate(x) for x in zip((self.rows, self.scores, self.names), *self.pending))
        order = np.lexsort((rank_of(names.tolist()), -scores, rows))
        rows, scores, names = rows[order], scores[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last, kept = place == self.limit - 1, place < self.limit
        self.rows, self.scores, self.names = rows[kept], scores[kept], names[kept]
        self.pending, self.n_pending = [], 0
        return rows[last], scores[last]
