import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def texts():
    rng = random.Random(3)
    made = ["", "  a  b ", "<|endoftext|> x<|startoftext|>y<|end", "It's we'LL ΣΑΣ İi ﬁ 你好 １２ ǅ ẞ K Å é ́", "a\x1cb\x85c"]
    made += ["abab" * 3000, "\n", "!?!?..##", "😀😀 zwölf"]
    return made + ["".join(rng.choice("abcdethingro'sLl é12.!<|>\n") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_as_the_library(encoder, library):
    made = texts()
    want = library.encode_batch(made, add_special_tokens=False)
    got = encoder.encode(made)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    assert [encoder.decode(g) for g in got] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_states_of_prefixes_are_those_of_merging(encoder):
    words = {w.encode() for w in ("the", "then", "thenth", "thanthe", "a", "aa", "aaa", "aaaa", "ththth", "é")}
    for word, ids in encoder.encode_words(words).items():
        names = [encoder.names[i] for i in ids]
        back = {b: c for c, b in bpe.byte_names().items()}
        symbols = [back[b] for b in word]
        symbols[-1] += "</w>"
        assert names == encoder.merged(symbols)


def test_pieces_in_use_stay_when_the_store_is_full(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    for text in ("a b c d", "a b c d e f g h", "a z y x w v", "a b"):
        (got,) = encoder.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, docs_of, odd, library):
    rows = odd + [(9, "Hello <|endoftext|> World " * 50_000)]
    docs = docs_of(rows).repartition(3)
    got = bpe.round_trip(docs, PATH).collect()

    def want(i, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    key = str
    assert sorted(map(tuple, got), key=key) == sorted((want(i, t) for i, t in rows), key=key)
    again = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {r.text for r in again.where("doc_id = 4").collect()} == {"one</w>"}
    assert bpe.round_trip(docs_of([]), PATH).count() == 0
