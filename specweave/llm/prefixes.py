"""The prefix trie of conversations as a table of nodes.

Every prefix of a conversation has a 128-bit digest.  A count-min sketch of all digests proves most prefixes to
belong to one conversation; their nodes are written where they stand.  Only prefixes that may be shared are
grouped exactly.  No step walks the trie: a conversation is the smallest member of all its prefixes from some
depth on, so leaves, children and saved text below a node are sums over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.tables import stored

GROUP = 100  # conversations that begin with turns of the same one
HEADS = 6
SPAN = 4096  # turns numbered and summed at a time
LEAST_CELLS, MOST_CELLS = 1 << 15, 1 << 27  # of a row of the sketch; one bit a cell is sent to the tasks
BUCKET = 1 << 15  # bits of one bitmap
EMPTY = hashlib.sha256().hexdigest()
NODE = ["depth", "p1", "p2"]
Rows = Iterator[pa.RecordBatch]


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests and code points of all turns in order, and the ranges of tasks each conversation is spread over."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    rows = rows.where("conv_id is not null").withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["conv_id", "turn", "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stored(
        ranged.select(
            "conv_id",
            F.spark_partition_id().alias("range"),
            F.monotonically_increasing_id().alias("at"),
            F.xxhash64(F.lit(1), "role", "digest").alias("h1"),
            F.xxhash64(F.lit(2), "digest", "role").alias("h2"),
            F.length("text").cast("long").alias("points"),
        )
    )
    ranges = turns.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    return turns, ranges.withColumn("before", before)


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, h1, h2, points`` of all rebuilt turns, and ``conv_id, length`` of all conversations."""
    turns, ranges = _turns(conversations)
    ranges = stored(ranges)
    own = ranges.groupBy("conv_id").agg(F.sum("n").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.withColumns({"head": head, "base": base})
    bases = own.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least("head", F.coalesce("of_base", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    length = F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))
    convs = stored(convs.select("conv_id", "base", "head", "taken", length.cast("long").alias("length")))

    # by conversation and range, so that a long conversation does not meet in one task
    places = ranges.join(convs.select("conv_id", "head", "taken"), "conv_id").drop("n")
    place = F.col("at") - F.col("first") + F.col("before") + 1
    turns = turns.join(places, ["conv_id", "range"]).withColumn("place", place)
    tails = turns.where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "h1", "h2", "points")
    starts = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS))
    starts = starts.select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "h1", "h2", "points")
    heads = convs.select("conv_id", "base", "taken").join(starts, "base").where("depth <= taken")
    return tails.unionByName(heads.select(tails.columns)), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame, convs: DataFrame, span: int) -> DataFrame:
    """``conv_id, depth, length`` with the digests ``p1, p2`` of the prefix, ``q1, q2`` of the one above, and ``total``.

    A turn's digest holds its place, so that the digests of a prefix are exclusive or over its turns, summed in
    spans of a conversation.  ``total`` counts the code points down to this turn, ``points`` those of this turn.
    """
    turns = turns.withColumns(
        {
            "x1": F.xxhash64(F.lit(1), "depth", "h1", "h2"),
            "x2": F.xxhash64(F.lit(2), "h2", "h1", "depth"),
            "span": F.floor((F.col("depth") - 1) / F.lit(span)).cast("long"),
        }
    )
    sums = {"c1": F.bit_xor("x1"), "c2": F.bit_xor("x2"), "c": F.sum("points")}
    above = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy("conv_id", "span").agg(*(f.alias(n) for n, f in sums.items()))
    spans = spans.select("conv_id", "span", F.bit_xor("c1").over(above).alias("c1"), F.bit_xor("c2").over(above).alias("c2"), F.sum("c").over(above).alias("c"))
    spans = spans.join(convs, "conv_id")
    own = Window.partitionBy("conv_id", "span").orderBy("depth")
    summed = turns.withColumns({"s1": F.bit_xor("x1").over(own), "s2": F.bit_xor("x2").over(own), "s": F.sum("points").over(own)})
    summed = summed.join(spans, ["conv_id", "span"])

    def carried(sum_: str, carry: str) -> Column:
        return F.col(sum_).bitwiseXOR(F.coalesce(carry, F.lit(0).cast("long")))

    p1, p2 = carried("s1", "c1"), carried("s2", "c2")
    return stored(
        summed.select(
            "conv_id",
            "depth",
            "length",
            p1.alias("p1"),
            p2.alias("p2"),
            p1.bitwiseXOR(F.col("x1")).alias("q1"),
            p2.bitwiseXOR(F.col("x2")).alias("q2"),
            "points",
            (F.col("s") + F.coalesce("c", F.lit(0))).alias("total"),
        )
    )


def _sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """Two rows of ``cells`` counters of a count-min sketch over all prefixes, as one bit each: is it above one?

    Counters are kept up to that bit, so both rows take at most MOST_CELLS / 4 bytes, whatever the input.
    """
    rows = F.explode(F.array(F.col("p1").bitwiseAND(F.lit(cells - 1)), F.col("p2").bitwiseAND(F.lit(cells - 1)) + cells))
    counters = prefixes.select(rows.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    full = counters.where("n > 1").groupBy(F.floor(F.col("cell") / F.lit(BUCKET)).cast("int").alias("bucket"))
    at = (F.col("cell") % BUCKET).cast("long")
    bits = np.zeros(2 * cells // 8, np.uint8)
    width = BUCKET // 8
    for r in full.agg(F.bitmap_construct_agg(at).alias("bits")).toLocalIterator():
        bits[r.bucket * width : (r.bucket + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return bits


def _screen(sent, cells: int, columns: list[str]) -> Callable[[Rows], Rows]:
    """Adds ``shared`` and ``shared_above``: may another conversation have this prefix, or the one above it?"""

    def run(batches: Rows) -> Rows:
        bits = sent.value

        def above_one(batch: pa.RecordBatch, first: str, second: str) -> np.ndarray:
            out = np.ones(batch.num_rows, bool)
            for k, name in enumerate((first, second)):
                cell = (batch.column(name).to_numpy(zero_copy_only=False) & (cells - 1)) + k * cells
                out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
            return out

        for batch in batches:
            above = above_one(batch, "q1", "q2") | (batch.column("depth").to_numpy(zero_copy_only=False) == 1)
            flags = [pa.array(above_one(batch, "p1", "p2")), pa.array(above)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *flags], [*columns, "shared", "shared_above"])

    return run


def _ids(conv_id: str = "conv_id") -> Column:
    return F.sha2(F.col(conv_id).cast("string"), 256)


def _listed() -> Callable[[Rows], Rows]:
    """SHA-256 of the sorted ids of each node, which stream by sorted; no list is held."""

    def run(batches: Rows) -> Rows:
        now, sha = None, None
        for batch in batches:
            out: list[tuple] = []
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if node != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            yield _batch(out)
        if now is not None:
            yield _batch([(*now, sha.hexdigest())])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*NODE, "ends_sha256"])

    return run


def _ends(ends: DataFrame) -> DataFrame:
    """``ends_sha256`` of every node at which conversations end."""
    ends = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return ends.mapInArrow(_listed(), "depth long, p1 long, p2 long, ends_sha256 string")


_MEASURES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, span: int = SPAN, least_cells: int = LEAST_CELLS, most_cells: int = MOST_CELLS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    A conversation c is rebuilt from the first h turns of conversation c - c % 100, where h is its crc32 modulo 6,
    and its own turns after the first h.  ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (code points of the texts that members share, over the subtree)
    and ``ends_sha256`` (of the ids of the conversations that end here).

    Turns stand by turn, nulls first, then by role and digest of the text; a null role or text is empty;
    repeated rows are turns of their own.  Rows without conversation are left out; no rows give no nodes.  Other
    columns are not read.  Prefixes are equal where their 128-bit digests are.  Between ``least_cells`` and
    ``most_cells`` the sketch grows with the prefixes; beyond, more of them are grouped exactly, with the same result.
    """
    turns, convs = _rebuilt(conversations)
    convs = stored(convs)
    prefixes = _prefixes(turns, convs, span)
    cells = least_cells
    n = prefixes.count()
    while cells < min(2 * n, most_cells):
        cells *= 2
    sent = convs.sparkSession.sparkContext.broadcast(_sketch(prefixes, cells))
    columns = [c for c in prefixes.columns if c not in ("q1", "q2")]
    kept = ", ".join(f"{c} long" for c in columns)
    screened = prefixes.mapInArrow(_screen(sent, cells, columns), f"{kept}, shared boolean, shared_above boolean")

    shared = screened.where("shared").drop("shared", "shared_above")
    root = convs.agg(F.min("conv_id").alias("root"), F.max("length").alias("deepest")).first()
    if root.root is None:
        deepest, least = 0, -1
    else:
        deepest, least = root.deepest, root.root
    groups = shared.groupBy(NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("longest"))
    members = stored(shared.join(groups, NODE))

    # of each conversation: the depth from which on it is the smallest member, and who is above
    up = F.max(F.when(F.col("owner") != F.col("conv_id"), F.struct("depth", "owner", "total")))
    leaf = F.max(F.when(F.col("depth") == F.col("length"), (F.col("owner") == F.col("conv_id")) & (F.col("longest") == F.col("depth"))))
    seen = members.groupBy("conv_id").agg(up.alias("up"), leaf.alias("leaf"))
    is_root = F.col("conv_id") == least
    childless = F.when(F.col("length") == 0, is_root & F.lit(deepest == 0)).otherwise(F.lit(True))
    owned = convs.join(seen, "conv_id", "left").select(
        "conv_id",
        "length",
        F.coalesce(F.col("up.depth") + 1, F.when(is_root, 0).otherwise(1)).cast("long").alias("own_from"),
        F.coalesce("up.owner", F.when(~is_root, F.lit(least))).cast("long").alias("above"),
        F.coalesce("up.total", F.lit(0)).cast("long").alias("shared_total"),
        F.coalesce("leaf", childless).cast("long").alias("leaf"),
    )
    owned = stored(owned)

    parent = F.when(F.col("depth") > F.col("own_from"), F.col("conv_id")).otherwise(F.col("above"))
    child = (F.col("own_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    saved = F.when(F.col("depth") < F.col("own_from"), F.col("shared_total") - F.col("total") + F.col("points")).otherwise(0)

    def measured(rows: DataFrame) -> DataFrame:
        return rows.groupBy(NODE).agg(
            F.min("conv_id").alias("conv_id"),
            F.max(F.when(F.col("conv_id") == F.col("owner"), parent)).alias("parent_conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(child.cast("long")).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(saved).cast("long").alias("saved_tokens"),
        )

    zero = F.lit(0).cast("long")
    roots = owned.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "*", F.lit(least).alias("owner"), zero.alias("total"), zero.alias("points"))
    rows = members.join(owned.drop("length"), "conv_id")
    nodes = measured(rows).unionByName(measured(roots))
    ends = members.where("depth = length").select(*NODE, "conv_id").unionByName(roots.where("length = 0").select(*NODE, "conv_id"))
    nodes = nodes.join(_ends(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))

    # proven to belong to one conversation: written without shuffle, but for the first one below a shared prefix
    one, end = F.lit(1).cast("long"), F.col("depth") == F.col("length")
    alone = screened.where("not shared").select(
        "conv_id",
        "depth",
        "shared_above",
        one.alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(end, _ids()).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    inner = alone.where("not shared_above").withColumn("parent_conv_id", F.col("conv_id"))
    first = alone.where("shared_above").join(owned.select("conv_id", "own_from", "above"), "conv_id").withColumn("parent_conv_id", parent)
    return nodes.select(_MEASURES).unionByName(inner.select(_MEASURES)).unionByName(first.select(_MEASURES))
