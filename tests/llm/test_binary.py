import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import binary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_pack_and_unpack(values):
    control, data = binary.pack(np.array(values, np.uint32))
    assert binary.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def test_encoder_is_the_library(library):
    rng = random.Random(5)
    texts = ["", " ", "  a  b ", "\n", "a \n b", "a\n b", " a", "a ", "x<|endoftext|> y <|endoftext|>z", "你好 １２  b 　 c\x1c d\x85 e"]
    texts += ["".join(rng.choice("abcd et  \n\t'sLl12.,! é") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    with open(PATH, encoding="utf-8") as f:
        encoder = binary.ByteBpe(f.read())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new pieces, then known ones
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want


def test_new_words_are_merged_together(library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeiouthns  \n',.é") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(PATH, encoding="utf-8") as f:
        encoder = binary.ByteBpe(f.read())
    monkeypatch.setattr(encoder, "library", None)  # asked for no usual word
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want
    monkeypatch.setattr(binary, "STORED_IDS", 50)  # words met lately are forgotten, texts come together
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    for _ in range(2):
        ids, of = encoder.encode_all(np.frombuffer(b"".join(raw), np.uint8), bounds)
        assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == want


def test_stretches_for_the_library(library):
    texts = ["=" * 200 + " a", "é" * 70 + " b", "a 你 b, 　c — d 's", "x <|endoftext|>  <|endoftext|>y", "\x85 a\u2003 b", "it's'll 'S 's", ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    with open(PATH, encoding="utf-8") as f:
        encoder = binary.ByteBpe(f.read())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    ids, of = encoder.encode_all(data, bounds)
    assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == want


def test_files(spark, docs_of, odd, library, tmp_path, monkeypatch):
    rows = odd + [(-5, "first"), (10**12, "the end " * 30_000)] + [(100 + i, f"text {i} of many") for i in range(300)]
    binary.write_ids(docs_of(rows).repartition(5), PATH, f"file://{tmp_path}/ids")
    got = binary.read_ids(spark, f"file://{tmp_path}/ids").collect()
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))  # null first
    at = 0
    by_text = {}
    for i, t in rows:
        by_text.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        by_text[r.doc_id].remove(np.frombuffer(bytes(r.ids), "<u4").tolist())
        at += r.n_tokens
    assert not any(by_text.values())
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in binary.checksums(spark, f"file://{tmp_path}/ids").collect()}
    assert sums == {(r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got}


def test_many_blocks_in_a_shard(spark, docs_of, library, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK_IDS", 40)
    rows = [(i * 37 % 1009, f"text {i} " + "of words " * (i % 9)) for i in range(1009)]
    folder = f"file://{tmp_path}/ids"
    binary.write_ids(docs_of(rows).repartition(6), PATH, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 100 and len(binary._offsets(blocks)) == 4  # one number a shard, not a block
    at = 0
    for r, (i, t) in zip(binary.checksums(spark, folder).orderBy("start").collect(), sorted(rows)):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents(spark, docs_of):
    assert binary.round_trip(docs_of([]), PATH).count() == 0
