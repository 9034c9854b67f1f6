"""Token ids as byte-aligned variable-length integers with separate control bytes.

Ids are replaced by their rank of frequency in the corpus, so that most need one byte.  A value takes
one to four bytes; the lengths of four values share a control byte.  Control and data bytes stand apart,
so a reader finds all lengths by one table lookup for each control byte, and gathers the bytes with NumPy.

A written folder has two Parquet tables: ``ranks`` (one row: the ids by rank) and ``blocks`` (documents in
ascending order: ``shard, start, doc_ids, counts, control, data``).  Shards are numbered in the order of
documents; ``start`` counts the ids of the shard before a block, so a reader needs one sum for each shard.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.bpe import byte_names
from specweave.llm.merges import LONGEST, Merges
from specweave.llm.tables import shared_folder, stored
from specweave.llm.words import span_hashes, texts_of

END = 2
BLOCK_IDS = 1 << 18
WORD_SLOTS = 1 << 20
STORED_IDS = 1 << 23
CACHED_PIECES = 100_000  # that went to the library
BLOCKS = "shard int, start long, doc_ids array<long>, counts array<long>, control binary, data binary"

_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4)) & 3) + 1).astype(np.uint8)  # control byte -> four lengths


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32, copy=False)
    size = np.ones(-(-len(values) // 4) * 4, np.uint8)
    longer = [np.flatnonzero(values >> np.uint32(8 * j)) for j in (1, 2, 3)]
    for at in longer:
        size[at] += 1
    control = ((size.reshape(-1, 4) - 1) << (2 * np.arange(4, dtype=np.uint8))).sum(1, dtype=np.uint8)
    size = size[: len(values)]
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    data[ends - size] = values.astype(np.uint8)
    for j, at in enumerate(longer, 1):
        data[ends[at] - size[at] + j] = (values[at] >> np.uint32(8 * j)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that :func:`pack` wrote."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(size, dtype=np.int64) - size
    out = raw[starts].astype(np.uint32)
    for j in (1, 2, 3):
        at = np.flatnonzero(size > j)
        out[at] |= raw[starts[at] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


LETTER, NUMBER, OTHER, SPACE, ODD = range(5)


def _kinds() -> np.ndarray:
    """The class of every character up to U+024F for the library's split."""
    classes = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]
    return np.array([next(k for k, c in enumerate(classes) if c.match(chr(x))) for x in range(0x250)], np.uint8)


class ByteBpe:
    """The ids that the library's encoder gives, for many texts at once.

    Texts are cut into words as the library cuts them, by classes of characters.  Words of a slice that were not
    met lately are merged together, each once.  Where a text has characters beyond Latin letters or special
    tokens, the stretch between two blanks that stand between other characters goes to the library itself, as
    no token goes over such a border.
    """

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.letters = letters = {b: c for c, b in byte_names().items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.merges = Merges(np.array([vocab[letters[b]] for b in range(256)]), pairs, made)
        self.kinds = _kinds()
        self.by_library: dict[bytes, np.ndarray] = {}
        self.keys = np.zeros(WORD_SLOTS, np.uint64)  # hashes of words met lately, by their first bits
        self.first, self.count = np.zeros(WORD_SLOTS, np.int64), np.zeros(WORD_SLOTS, np.int64)
        self.store, self.filled = np.empty(1 << 16, np.uint32), 0  # their ids

    def _kind(self, data: np.ndarray) -> np.ndarray:
        """The class of every byte's character."""
        kind = self.kinds[data]
        wide = np.flatnonzero(data >= 0x80)
        if len(wide):
            b = data[wide]
            lead = wide[b >= 0xC0]
            first = data[lead]
            at = (first.astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F
            own = np.where((first < 0xCA) & (at < len(self.kinds)), self.kinds[np.minimum(at, len(self.kinds) - 1)], ODD)
            kind[wide] = own[np.cumsum(b >= 0xC0) - 1]
        raw = None
        for t in self.special:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(t)
            while at >= 0:
                kind[at : at + len(t)] = ODD
                at = raw.find(t, at + 1)
        return kind

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words of some texts, and which of them only the library knows to cut."""
        n, kind = len(data), self._kind(data)
        top = np.zeros(n + 1, bool)
        top[bounds] = True
        new = top[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], n)
        of = kind[runs]
        begin = np.zeros(n + 1, bool)
        # a blank before other characters is theirs; of more white space the last character stands alone
        joined = (of != SPACE) & ~top[runs] & (data[runs - 1] == 32)
        begin[runs - joined] = True
        inner = ends[(of == SPACE) & ~top[ends]] - 1
        begin[inner - (data[inner] >= 0x80)] = True
        # 's 't 're 've 'm 'll 'd, where no blank or other sign stands before
        at = runs[:-1][(data[runs[:-1]] == 39) & (np.diff(runs) == 1) & ~joined[:-1] & (of[1:] == LETTER) & ~top[runs[1:]]]
        if len(at):
            a, b = data[at + 1], np.where(top[at + 2], 0, data[np.minimum(at + 2, n - 1)])
            short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            long = np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            at, size = at[short | long], np.where(short, 2, 3)[short | long]
            begin[at + 1] = False
            begin[at + size] = True
        odd = np.flatnonzero(kind == ODD)
        begin[n] = False
        if not len(odd):
            return np.flatnonzero(begin), np.empty(0, np.int64)
        border = top[:-1].copy()
        border[1:-1] |= (data[1:-1] == 32) & (kind[1:-1] == SPACE) & (kind[:-2] < SPACE) & (kind[2:] < SPACE) & ~top[2:-1]
        border = np.flatnonzero(border)
        stretch = np.unique(np.searchsorted(border, odd, "right") - 1)
        border = np.append(border, n)
        for s, e in zip(border[stretch].tolist(), border[stretch + 1].tolist()):
            begin[s:e] = False
            begin[s] = True
        starts = np.flatnonzero(begin)
        return starts, np.searchsorted(starts, border[stretch])

    def _alone(self, word: bytes, cut: bool) -> np.ndarray:
        """Ids by the library, of one word or of a text that it has to cut."""
        ids = self.by_library.get(word)
        if ids is None:
            if cut:
                found = self.library.encode(word.decode(), add_special_tokens=False).ids
            else:
                found = [t.id for t in self.library.model.tokenize(word.decode("latin-1").translate(self.letters))]
            if len(self.by_library) >= CACHED_PIECES:
                self.by_library.clear()
            ids = np.array(found, np.uint32)
            if len(word) < 1000:
                self.by_library[word] = ids
        return ids

    def _stored(self, ids: np.ndarray) -> int:
        """Where ``ids`` now begin among the ids held."""
        at, to = self.filled, self.filled + len(ids)
        if to > len(self.store):
            self.store = np.concatenate((self.store[:at], np.empty(to, np.uint32)))
        self.store[at:to], self.filled = ids, to
        return at

    def encode_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[bounds[i]:bounds[i + 1]]`` in UTF-8, and the bounds of each text's."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
        if self.filled > STORED_IDS:
            self.keys[:], self.filled = 0, 0
        starts, odd = self._words(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        slot = (hashes >> np.uint64(64 - WORD_SLOTS.bit_length() + 1)).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        usual = ends - starts <= LONGEST
        usual[odd] = False
        new = np.flatnonzero((self.keys[slot] != hashes) & usual)
        own, at, which = np.unique(hashes[new], return_index=True, return_inverse=True)
        at = new[at]
        ids, f, c = self.merges.encode(data, starts[at], ends[at])
        f += self._stored(ids)
        first[new], count[new] = f[which], c[which]
        kept = slot[at]
        self.keys[kept], self.first[kept], self.count[kept] = own, f, c
        cut = set(odd.tolist())
        for i in np.flatnonzero(~usual).tolist():
            ids = self._alone(data[starts[i] : ends[i]].tobytes(), i in cut)
            first[i], count[i] = self._stored(ids), len(ids)
        to = np.concatenate(([0], np.cumsum(count)))
        where = np.repeat(first - to[:-1], count)
        where += np.arange(len(where))
        return self.store[where], to[np.searchsorted(starts, bounds)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()


_ENCODERS: dict[int, ByteBpe] = {}


def _kind(path: str, end: int) -> str:
    """The smallest integers that hold every id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max(end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
    return "<u2" if top < 1 << 16 else "<u4"


def tokens(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """``doc_id, tie, ids``: the ids of every whole text and an end id, encoded where the text is read; ``tie`` is a
    hash of the text, so that many rows of one id do not meet in one shard.

    A null or empty text has the end id alone; repeated rows stay rows of their own; other columns are
    not read.
    """
    spark, kind = docs.sparkSession, _kind(path, end)
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary: some MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(file.value.encode())
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = ByteBpe(file.value)
        encode = _ENCODERS[key].encode_all
        for batch in batches:
            batch.column("text").validate(full=True)
            for first, to, data, bounds in texts_of(batch.column("text")):
                ids, of = encode(data, bounds)
                ids = np.insert(ids.astype(kind), of[1:], end)
                of = (of + np.arange(len(of))).tolist()
                made = pa.array([ids[a:b].tobytes() for a, b in zip(of, of[1:])], pa.binary())
                rows = batch.slice(first, to - first)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), made], names=["doc_id", "tie", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, ids binary")


def ranked(encoded: DataFrame, kind: str) -> np.ndarray:
    """The ids by falling frequency in all documents; as many as the vocabulary has, whatever the data."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            # all ids of a batch, whichever document they are of
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = encoded.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    return rows["id"].to_numpy().astype("<u4")


def write_ids(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Encode the texts of ``docs`` and write them to ``folder`` in this file format, in ascending order of id (null
    first; rows of one id by a hash of their texts).

    A block holds whole documents, BLOCK_IDS ids or one longer document.  Ids are shuffled, not texts.
    """
    spark, kind = docs.sparkSession, _kind(path, end)
    encoded = stored(tokens(docs, path, end))
    by_rank = ranked(encoded, kind)
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    sent = spark.sparkContext.broadcast(rank)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            counts = [len(raw) // np.dtype(kind).itemsize for raw in ids]
            control, data = pack(sent.value[np.frombuffer(b"".join(ids), kind)])
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([names], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([control], pa.binary()),
                pa.array([data], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "start", "doc_ids", "counts", "control", "data"])

        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                names.append(name)
                ids.append(raw)
                size += len(raw) // np.dtype(kind).itemsize
                if size >= BLOCK_IDS:
                    yield made()
                    names, ids, start, size = [], [], start + size, 0
        if names:
            yield made()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "ids").mapInArrow(packed, BLOCKS).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document of a written folder.

    ``start`` counts the ids of all documents before it.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return _decoded(spark, folder, blocks, lambda raw: pa.array(raw, pa.binary()), "ids binary")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a written folder."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return _decoded(spark, folder, blocks, lambda raw: pa.array([zlib.crc32(r) for r in raw], pa.int64()), "ids_crc32 long")


def _decoded(spark: SparkSession, folder: str, blocks: DataFrame, made, column: str) -> DataFrame:
    table = spark.read.parquet(f"{folder}/ranks").first()
    sent = spark.sparkContext.broadcast((np.frombuffer(bytes(table.ids), "<u4") if table else np.zeros(0, "<u4"), _offsets(blocks)))
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank, offsets = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["counts"], np.int64)
                ids = by_rank[unpack(r["control"], r["data"], int(n.sum()))]
                of = np.concatenate(([0], np.cumsum(n)))
                raw = [ids[a:b].tobytes() for a, b in zip(of[:-1], of[1:])]
                columns = [
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(offsets[r["shard"]] + r["start"] + of[:-1]),
                    pa.array(n),
                    made(raw),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", name])

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def _offsets(blocks: DataFrame) -> np.ndarray:
    """Ids before every shard.  One number a shard: as many as the shuffle had partitions, whatever the data."""
    ends = F.max(F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    sums = blocks.groupBy("shard").agg(ends.alias("n")).toPandas()
    sizes = np.zeros(int(sums["shard"].max()) + 1 if len(sums) else 0, np.int64)
    sizes[sums["shard"]] = sums["n"]
    return np.cumsum(sizes) - sizes


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Written to a new folder in the shared folder, read back: see :func:`checksums`."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, folder)
    return checksums(spark, folder)
