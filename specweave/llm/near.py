"""Near duplicates: b-bit MinHash signatures, a multi-index Hamming join, checks on full sets.

A signature has CHUNKS * CHUNK positions of BITS bits.  If two signatures differ in fewer than
CHUNKS * (ERRORS + 1) positions, some chunk differs in at most ERRORS of them (pigeonhole).  Every
document is filed under each chunk with each choice of ERRORS positions left out, so such a pair
meets under at least one key.  At a similarity of 0.75, 40 or more of 80 positions differ with a
probability below 1e-6; no pair of documents that meets is dropped but by the full sets.

Texts with equal sets are one class from the start.  Within a key no pairs are enumerated at
first: every class is held against the class of the key that meets most others, and components
are formed.  Only keys that still hold several components go on; of their classes those pairs are
checked that lie in different components and can be near by their rarest shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.graph import components
from specweave.llm.tables import narrowed, stored
from specweave.llm.words import NOT_SPACE, mixed, texts_of, words_of

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 20, 4, 1
BITS = 16
POSITIONS = CHUNKS * CHUNK
MOST_APART = CHUNKS * (ERRORS + 1) - 1
PERCENT = 75
BLOCK = 1024

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, POSITIONS, np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of every text)."""
    for first, _, data, bounds in texts_of(column):
        words = words_of(data, bounds, NOT_SPACE, True)
        hashes = words.hashes()
        at, grams = words.grams(hashes, SHINGLE)
        cut = np.searchsorted(at, words.of)
        out = []
        for d in range(words.n):
            a, b = words.of[d], words.of[d + 1]
            if b - a >= SHINGLE:
                out.append(np.unique(grams[cut[d] : cut[d + 1]]))
            elif b > a:  # the whole sequence is one shingle
                key = hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest()
                out.append(np.frombuffer(key, np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
        yield first, out


def signature(shingles: np.ndarray) -> bytes:
    """The low BITS of the smallest value under every hash function."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * _FACTORS + _TERMS
        np.minimum(low, part.min(0), out=low)
    return (mixed(low) & np.uint64((1 << BITS) - 1)).astype("<u2").tobytes()


def keys_of(signatures: list[bytes]) -> np.ndarray:
    """Every signature's keys: a chunk, the positions left out, and the values of the others."""
    values = np.frombuffer(b"".join(signatures), "<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
    out = []
    for i, kept in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
        for chunk in range(CHUNKS):
            key = np.full(len(values), i * CHUNKS + chunk, np.uint64)
            for p in kept:
                key = key << np.uint64(BITS) | values[:, chunk, p]
            out.append(key.astype(np.int64))
    return np.stack(out, 1)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text")):
                some = [s if len(s) else None for s in sets]
                keys = [None if s is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([None if s is None else signature(s) for s in some], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _members(classes: DataFrame) -> DataFrame:
    """``key, node``: every class under each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = keys_of(part.column("signature").to_pylist())
                nodes = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _near_signatures(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs whose signatures differ in MOST_APART positions at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, POSITIONS) for c in ("x", "y"))
                keep = (x != y).sum(1) <= MOST_APART
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    of = classes.select("node", "signature")
    both = (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .join(of.toDF("a", "x"), "a")
        .join(of.toDF("b", "y"), "b")
    )
    return both.mapInArrow(run, "a long, b long")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, shingles``: the full sets of the classes ``node``."""
    named = stored(nodes.join(classes, "node").select("node", "set_key", F.col("low").alias("doc_id")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found in shingle_sets(batch.column("text")):
                raw = [s.tobytes() for s in found]
                keys = [hashlib.blake2b(s, digest_size=16).digest() for s in raw]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["set_key", "shingles"])

    wanted = narrowed(_texts(docs), named.select("doc_id").where("doc_id is not null").distinct(), "left_semi")
    if not named.where("doc_id is null").isEmpty():  # classes that no id names
        wanted = wanted.union(_texts(docs).where("doc_id is null"))
    full = wanted.mapInArrow(sets, "set_key binary, shingles binary")
    # rows of one id can have several sets, and a class several rows
    full = full.join(named.select("set_key", "node"), "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return stored(full)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = [_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return stored(both.mapInArrow(check, "a long, b long"))


def _rarest(sets: DataFrame) -> DataFrame:
    """``key, node, size, place``: the shingles of which two near sets must share one.

    A set's shingles are put in order, those that fewest sets have first.  Near sets share PERCENT of the
    larger one, so they share one of the first ``size - needed + 1``.  Shingles of one set are left out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                found = np.frombuffer(raw, np.int64)
                columns = [pa.array(found), *(pa.array(np.full(len(found), x)) for x in (node, len(found)))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "size"])

    rows = sets.mapInArrow(spread, "key long, node long, size long")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("node").orderBy("n", "key")
    first = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1
    rows = rows.join(held, "key").withColumn("place", F.row_number().over(order))
    return rows.where((F.col("place") <= first) & (F.col("n") > 1)).select("key", "node", "size", "place")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((x, y), key=len)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of ``node``, which is the node itself where no link holds it."""
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _needed(x: Column, y: Column) -> Column:
    """Whether sets can be near that share no shingle before the places given and ``x`` or fewer after."""
    return (100 + PERCENT) * x >= PERCENT * y


def _across(rarest: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of different components that can be near.

    Sets that first meet at a place share at most what stands from there on; that leaves few pairs
    even among many half-alike sets.  Within a key, classes outside its largest component are held
    against all; both sides are dealt into blocks that meet under a join key of their own, whatever the
    size of the key.
    """

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows that can still meet a set of another component under their key."""
        keys = rows.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.min("size").alias("least"))
        keys = keys.where("p <> q").select("key", "least")
        left = 1 + F.col("size") - F.col("place")
        return rows.join(keys, "key").where(_needed(left, F.col("size") + F.col("least"))).drop("least")

    rows = stored(mixed(mixed(_labelled(rarest, found))))
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    sizes = sizes.agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most")).where("n > most.c")
    blocks = sizes.select(
        "key",
        F.col("most.component").alias("largest"),
        F.ceil((F.col("n") - F.col("most.c")) / BLOCK).cast("int").alias("few"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("many"),
    )
    rows = rows.join(blocks, "key").withColumn("outside", F.col("component") != F.col("largest"))
    hashed = F.xxhash64("node")
    x = rows.where("outside").withColumn("i", F.pmod(hashed, "few")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    y = rows.withColumn("j", F.pmod(hashed, "many").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    x, y = x.withColumn("i", F.col("i").cast("int")).alias("x"), y.alias("y")
    after = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    met = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.i") == F.col("y.i"))
        & (F.col("x.j") == F.col("y.j"))
        & (F.col("x.component") != F.col("y.component"))
        & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
        & _needed(after, F.col("x.size") + F.col("y.size")),
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row.

    Documents are linked at a Jaccard similarity of 0.75 of their distinct shingles of five words
    (words: runs of non-space, A-Z lower-cased; fewer words are one shingle).  ``component_id`` is
    the smallest id reachable.

    Null and empty texts have no shingles, stand alone and are kept.  Repeated rows fall into one
    class.  A row without id takes part in links but gives no component its name; it is kept only
    where no row of its component has an id.  Other columns are not read.
    """
    sketches = stored(_sketches(docs))
    classes = sketches.where("set_key is not null").groupBy("set_key")
    classes = classes.agg(F.min("doc_id").alias("low"), F.min("signature").alias("signature"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))

    members = _members(classes)
    # as a table of its own, so that adaptive execution can split a key that very many classes have
    keys = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = stored(members.join(keys, "key"))
    # the class that meets most others is the likeliest to be near all of its group
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("best"))
    centres = centres.select("key", F.col("best.node").alias("b"))
    stars = shared.join(centres, "key").select(F.col("node").alias("a"), "b").where("a <> b")
    stars = stored(_near_signatures(stars, classes))
    links = _linked(stars, _sets(_ends(stars), docs, classes))
    found = stored(components(links))

    rows = stored(_labelled(shared.select("key", "node"), found))
    mixed = rows.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    rows = stored(rows.join(mixed, "key"))
    sets = _sets(rows.select("node").distinct(), docs, classes)
    more = stored(_near_signatures(_across(_rarest(sets), found), classes))
    found = stored(components(links.union(_linked(more, sets))))

    named = _labelled(classes, found)
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "component").select("set_key", "component_id")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document for each group of near duplicates.

    An id goes when none of its rows is kept.  Rows without id come after all ids, by a digest of all their
    columns: they go where their group has an id, else the one with the least digest stays, once.  Rows without
    words stand alone and stay.
    """
    names = docs.columns
    own = _free("near_key", names)
    known = F.col("doc_id").cast("long")
    top = docs.agg(F.max(known)).first()[0]
    after = max(top + 1 if top is not None else 0, 0)
    digest = F.xxhash64(F.to_json(F.struct(*names))).bitwiseAND(F.lit((1 << 61) - 1))
    keyed = docs.withColumn(own, F.coalesce(known, F.lit(after) + digest))
    found = near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text")).groupBy("doc_id").agg(F.max("kept").alias("any_kept"))
    gone = stored(found.where("not any_kept").select(F.col("doc_id").alias(own)))
    left = narrowed(keyed, gone, "left_anti").select(*names, own)
    nameless = known.isNull() & F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    return left.where(~nameless).unionByName(left.where(nameless).dropDuplicates([own])).drop(own)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
