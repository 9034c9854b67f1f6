"""BPE encoding by a trie of the distinct words, and decoding.

The BPE encoding of a prefix is its last token plus the encoding of what stands before that
token, and two tokens may stand side by side exactly if merging their joined symbols gives
them back.  So a walk down a trie of the distinct words needs one state a node, its last
token and the node where that token begins, and every shared prefix is encoded once.

Texts are cut at blanks, which never join tokens here; pieces already seen in a worker are
looked up, the words of the others enter the trie.  There is no shuffle, and a lost task is
simply run again.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from specweave.llm.recent import Recent

CACHED_PIECES = 200_000  # in each of two generations
MOST_PAIRS = 600_000
TRIE_WORDS = 50_000
SLICE_CHARS = 1 << 20
ENCODED = "doc_id long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_names() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    other = (b for b in range(256) if b not in set(plain))
    return names | {chr(256 + i): b for i, b in enumerate(other)}


class Suffixes:
    """Automaton over token spellings: after every byte, the tokens that end there, longest first."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        self.step: dict[int, int] = {}  # state * 256 + byte -> state
        own: list[tuple[int, int] | None] = [None]
        tree: list[list[tuple[int, int]]] = [[]]
        for spelling, i in tokens.items():
            state = 0
            for b in spelling:
                key = state << 8 | b
                if key not in self.step:
                    self.step[key] = len(own)
                    tree[state].append((b, len(own)))
                    own.append(None)
                    tree.append([])
                state = self.step[key]
            own[state] = (len(spelling), i)
        self.fallback = [0] * len(own)
        self.ending: list[list[tuple[int, int]]] = [[]] * len(own)
        level = [0]
        while level:
            below = []
            for state in level:
                for b, to in tree[state]:
                    self.fallback[to] = self.next(self.fallback[state], b) if state else 0
                    self.ending[to] = ([own[to]] if own[to] else []) + self.ending[self.fallback[to]]
                    below.append(to)
            level = below

    def next(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        found = self.step.get(key)
        if found is None:
            found = self.step[key] = self.next(self.fallback[state], byte) if state else 0
        return found


class WordBpe:
    """Encoder for a vocabulary with word ends, from the text of a tokenizer file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.text = text
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.names = dict(zip(self.vocab.values(), self.vocab, strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.code = byte_names()
        self.parts: dict[str, tuple[str, str]] = {}
        for pair in self.rank:
            self.parts.setdefault(pair[0] + pair[1], pair)
        inner: dict[bytes, int] = {}
        last: dict[bytes, int] = {}
        self.symbols: dict[int, list[str]] = {}
        for token, i in self.vocab.items():
            stem = token.removesuffix(end)
            letters = list(stem)
            if not stem or any(c not in self.code for c in letters):
                continue
            into = inner
            if stem != token:
                into, letters[-1] = last, letters[-1] + end
            if self.merged(letters) == [token]:  # others never come out of merging
                into[bytes(self.code[c] for c in stem)] = i
                self.symbols[i] = letters
        self.inner, self.last = Suffixes(inner), Suffixes(last)
        made = {p[0] + p[1]: r for p, r in reversed(self.rank.items())}
        self.in_order = all(made.get(x, -1) < r for p, r in self.rank.items() for x in p)
        self.edges = {i: (self._edge(i, 1), self._edge(i, 0)) for i in self.symbols}
        self.fits: dict[int, bool] = {}
        self.pieces = Recent(CACHED_PIECES)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.library = None

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the best pair as long as there is one."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.rank.get(p, 1 << 30))
            if best not in self.rank:
                break
            out: list[str] = []
            i = 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    out.append(best[0] + best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _edge(self, token: int, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one side of a token while it is merged, each with the
        rank of the merge that ends it."""
        name, until, out = self.names[token], 1 << 30, []
        while True:
            out.append((name, until))
            if name not in self.parts:
                return out
            until = self.rank[self.parts[name]]
            name = self.parts[name][side]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether no merge goes over the border of two tokens."""
        if not self.in_order:
            return self.merged(self.symbols[a] + self.symbols[b]) == [self.names[a], self.names[b]]
        rank = self.rank
        for x, x_until in self.edges[a][0]:
            for y, y_until in self.edges[b][1]:
                r = rank.get((x, y))
                # of equal merges the left one goes first
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def encode_words(self, words: set[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct words, by a depth-first walk of their trie.

        Sorted, the words are the trie in the order of that walk, and only the path to the
        current word is held: a word keeps the states of what it shares with the one before.
        """
        token = [0] * (1 + max(map(len, words), default=0))
        begin = token.copy()  # a prefix's last token, and the length of the prefix before it
        inner, last = token.copy(), token.copy()  # states of the automata
        step, after, ending = self.inner.step, self.inner.next, self.inner.ending
        last_step, last_after, last_ending = self.last.step, self.last.next, self.last.ending
        fits, side_by_side = self.fits, self.side_by_side
        before, out = b"", {}
        for word in sorted(words):
            k, end = 0, len(word) - 1
            shared = min(len(before) - 1, end)
            while k < shared and before[k] == word[k]:
                k += 1
            before = word
            while k <= end:
                byte = word[k]
                state = last_step.get(last[k] << 8 | byte)
                if state is None:
                    state = last_after(last[k], byte)
                last[k + 1] = state
                if k < end:
                    state = step.get(inner[k] << 8 | byte)
                    if state is None:
                        state = after(inner[k], byte)
                    inner[k + 1] = state
                    found = ending[state]
                else:  # the last byte ends the word: its tokens are of their own kind
                    found = last_ending[state]
                k += 1
                for size, t in found:
                    at = k - size
                    if not at:
                        break
                    pair = token[at] << 32 | t
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = side_by_side(token[at], t)
                    if fit:
                        break
                token[k], begin[k] = t, at
            ids, at = [token[k]], begin[k]
            while at:
                ids.append(token[at])
                at = begin[at]
            ids.reverse()
            out[word] = ids
        return out

    def _plain_words(self, text: str) -> list[bytes]:
        if text and max(text) > "ɏ":  # beyond Latin letters, take the library's own tables
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.text)
            lower = self.library.normalizer.normalize_str(text)
            parts = self.library.pre_tokenizer.pre_tokenize_str(lower)
            return [bytes(self.code[c] for c in w) for w, _ in parts]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [w.encode() for w in self.word.findall(text.lower())]

    def _words(self, piece: str) -> list[bytes | int]:
        """Words, and ids of special tokens, in a piece of text."""
        if self.marks is None or "<|" not in piece:
            return self._plain_words(piece)
        out: list[bytes | int] = []
        for part in self.marks.split(piece):
            out += [self.special[part]] if part in self.special else self._plain_words(part)
        return out

    def learned(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of pieces of text not seen lately."""
        todo, out = list(pieces), {}
        for at in range(0, len(todo), TRIE_WORDS):
            words = {p: self._words(p) for p in todo[at : at + TRIE_WORDS]}
            known = self.encode_words({w for ws in words.values() for w in ws if isinstance(w, bytes)})
            for p, ws in words.items():
                ids = [i for w in ws for i in (known[w] if isinstance(w, bytes) else [w])]
                out[p] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut = [(t or "").split(" ") for t in texts]
        found = [self.pieces.found(c) for c in cut]
        new = {p for c, f in zip(cut, found) if None in f for p, i in zip(c, f) if i is None}
        if new:
            if len(self.fits) > MOST_PAIRS:
                self.fits.clear()
            known = self.learned(new)
            self.pieces.add(known)
            found = [[known[p] if i is None else i for p, i in zip(c, f)] if None in f else f for c, f in zip(cut, found)]
        return [b"".join(f) for f in found]

    def decode(self, ids: bytes) -> str:
        """The token strings; a vocabulary without decoder puts blanks between them."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, WordBpe] = {}


def _encoder(text: str) -> WordBpe:
    """One encoder a worker, so that later tasks find its pieces."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordBpe(text)
    return _ENCODERS[key]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in slices of bounded size; a longer text is a slice of its own."""
    texts, first, size = batch.column("text").to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _per_document(docs: DataFrame, path: str, schema: str, kernel) -> DataFrame:
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary: some MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(file.value)
        for batch in batches:
            for first, texts in _slices(batch):
                ids = batch.column("doc_id").slice(first, len(texts))
                columns = kernel(bpe, bpe.encode(texts))
                yield pa.RecordBatch.from_arrays([ids, *columns.values()], names=["doc_id", *columns])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of every whole text.

    Rows go through one by one: a null or empty text has no ids, repeated rows and null ids
    stay as they are, other columns are not read, an empty table gives an empty table.
    Special tokens written in a text count as such, as in the library's default.
    """
    return _per_document(docs, path, ENCODED, lambda bpe, ids: {"ids": pa.array(ids, pa.binary())})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: the decoded text of every row of :func:`encode`; null ids give null."""
    spark = encoded.sparkSession
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(file.value)
        for batch in batches:
            texts = [None if b is None else bpe.decode(b) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digested(bpe: WordBpe, ids: list[bytes]) -> dict[str, pa.Array]:
    return {
        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids], pa.string()),
    }


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass; edge cases as in :func:`encode`."""
    return _per_document(docs, path, DIGESTS, _digested)
