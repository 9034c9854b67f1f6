"""Toxicity, quality and the sample both learn from."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specweave.llm import labels as L
from specweave.llm import quality, toxicity
from specweave.llm.words import LETTERS, NOT_SPACE, words_of

INSULTS = ["snork", "blargh", "quibnit"]


def prose(rng, n=60):
    return " ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(n=900):
    """(doc_id, text, lang, toxic, quality); rude words anywhere, and text of signs for low quality."""
    rng = random.Random(4)
    out = []
    for k in range(n):
        words = prose(rng).split()
        rude, junk = rng.random() < 0.3, rng.random() < 0.3
        if rude:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        if junk:
            words = [w.upper() + rng.choice(["%%", "##!", "**"]) for w in words]
        out.append((k, " ".join(words), rng.choice(["en", "de"]), int(rude), int(not junk)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = [(r[0], r[1], r[2], 0.5, "x", None) for r in rows]
    docs += [(None, "snork " * 3, "en", 0.5, "x", None), (10_000, None, None, 0.5, "x", None), (10_001, "", "fr", 0.5, "x", None)]
    docs += [(0, rows[0][1], rows[0][2], 0.5, "x", None)] * 2
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, label string, ids binary")
    marks = [(r[0], r[4], r[3]) for r in rows] + [(5, 0, 0), (5, 1, 1), (77_777, 1, 1), (None, 1, 1), (6, None, None)]
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def accuracy(rows, truth, modulus, remainder):
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(held) > 50 and all(fold(r.doc_id, modulus) == remainder for r in held)
    assert not any(fold(r.doc_id, modulus) == remainder for r in rows if r.doc_id is not None and not r.held_out)
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_on_held_out_rows(tables):
    docs, marks = tables
    rows = toxicity.toxicity(docs, marks).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.rejected == (r.score >= r.threshold) for r in rows)
    assert accuracy(rows, {r[0]: r[3] for r in corpus()}, 5, 0) > 0.95
    scores = {r.score for r in rows if r.doc_id in (10_000, 10_001)}
    assert len(scores) == 1  # null and empty texts are the same
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    (nameless,) = [r for r in rows if r.doc_id is None]
    assert nameless.predicted == 1 and not nameless.held_out
    kept = toxicity.harmless(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.rejected)


def test_quality_on_held_out_rows(tables):
    docs, marks = tables
    rows = quality.quality(docs, marks).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, {r[0]: r[4] for r in corpus()}, 4, 2) > 0.95
    assert len({r.score for r in rows if r.doc_id in (10_000, 10_001)}) == 1


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_without_labels_or_documents(tables, run):
    docs, marks = tables
    one_kind = marks.where("toxic = 0 and quality = 0")
    for given in (marks.limit(0), one_kind):
        rows = run(docs, given).collect()
        assert len(rows) == docs.count() and len({r.score for r in rows}) == 1
    assert run(docs.limit(0), marks).count() == 0


def test_sample_is_bounded_and_leaves_the_fold_out(tables):
    docs, marks = tables
    rows = L.labelled(docs, marks, "toxic", 5, 0, per_class=40).collect()
    by = {v: [r for r in rows if r.label == v] for v in (0, 1)}
    assert len(by[0]) == len(by[1]) == 40
    ids = [r.doc_id for r in rows]
    assert len(set(ids)) == 80 and 5 not in ids and not any(fold(i, 5) == 0 for i in ids)
    assert sorted(ids) == sorted(r.doc_id for r in L.labelled(docs.repartition(7), marks, "toxic", 5, 0, per_class=40).collect())
    assert {r.doc_id for r in L.labelled(docs, marks, "toxic", 5, 0, longest=10).collect()} == set()


def test_toxicity_learns_from_every_labelled_row(tables, monkeypatch):
    """No row is left out, whatever its length, and shards come to a model as good as one list does."""
    docs, marks = tables
    long = docs.sparkSession.createDataFrame([(20_001, "zebra " * 40_000, "xx")], "doc_id long, text string, lang string")
    given = docs.select("doc_id", "text", F.lit("xx").alias("lang")).union(long)
    known = marks.union(docs.sparkSession.createDataFrame([(20_001, 1, 1)], marks.schema))
    ids = {r.doc_id for r in L.all_labelled(given, known, "toxic")[0].collect()}
    # 5 has labels that contradict each other
    assert 20_001 in ids and ids == {r.doc_id for r in known.join(given.where("text is not null"), "doc_id").collect()} - {5}
    held = toxicity._shards(given, known).selectExpr("explode(rows) r").select("r.*").collect()
    assert sorted(r.doc_id for r in held) == sorted(i for i in ids if fold(i, 5) != 0)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    rows = toxicity.toxicity(docs, marks).collect()
    assert accuracy(rows, {r[0]: r[3] for r in corpus()}, 5, 0) > 0.95
    assert [r.score for r in rows] == [r.score for r in toxicity.toxicity(docs, marks).collect()]


def test_sums_of_many_changes_stay_whole(tables, monkeypatch):
    """Changes as large as those of many shards are added without leaving 64 bits."""
    docs, marks = tables
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    want = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    monkeypatch.setattr(toxicity, "FINE", 2.0**60)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, marks).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_harmless_documents_are_found_with_sums_of_many_changes(tables, monkeypatch):
    """The first stage of the pipeline, where the changes add up to more than 64 bits."""
    docs, marks = tables
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    want = sorted(r.doc_id for r in toxicity.toxicity(docs, marks).where("not rejected").collect())
    monkeypatch.setattr(toxicity, "FINE", 2.0**60)
    assert sorted(r.doc_id for r in toxicity.harmless(docs, marks).collect()) == want
    assert 0 < len(want) < docs.count()


def test_means_of_changes_are_those_of_whole_numbers(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng, n_shards = np.random.default_rng(5), 30
    start = toxicity.started(149, rng)
    total, n_steps, records = np.zeros((150, toxicity.SIZE)), np.zeros(150), []
    dense = np.zeros(len(start.dense))
    for k in range(n_shards):
        own = np.concatenate(([0], 1 + np.flatnonzero(rng.random(149) < 0.6)))
        before = toxicity.Weights(start.words[own], start.seen_words[own], start.dense, start.seen_dense)
        after = toxicity.Weights(*(a + rng.random(a.shape) * 2.0**k for a in before.arrays()))
        steps = rng.integers(0, 3, len(own))
        records.append(toxicity._changed(before, after, own, steps, k + 1))
        moved = (steps > 0) & (own > 0)
        total[own[moved]] += (steps[:, None] * (after.seen_words - before.seen_words))[moved]
        n_steps[own[moved]] += steps[moved]
        dense += (k + 1) * (after.seen_dense - before.seen_dense)
    got = toxicity.Weights(*(a.copy() for a in start.arrays()))
    means = [row for batch in toxicity._means(iter(records)) for row in zip(*(c.to_pylist() for c in batch.columns))]
    toxicity._mix(got, means)
    mean = total / np.maximum(n_steps, 1)[:, None]
    assert np.allclose(got.seen_words - start.seen_words, mean, rtol=1e-6, atol=1e-6)
    assert np.allclose(got.seen_dense - start.seen_dense, dense / sum(range(1, n_shards + 1)), rtol=1e-6)


def test_threshold_of_counted_scores():
    scores, labels = np.array([0.1, 0.4, 0.6, 0.9]), np.array([0, 1, 0, 1])
    counts = np.array([5, 3, 1, 2])
    assert toxicity.threshold(scores, labels, counts) == toxicity.threshold(np.repeat(scores, counts), np.repeat(labels, counts))


def test_scores_of_the_network_are_those_of_plain_convolution():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (0, 1, 2, 3, 9, 30)]
    ((_, ids, of),) = toxicity.word_ids(pa.array(texts))
    labels = np.array([0, 1, 0, 1, 0, 1])
    model = toxicity.fit([ids[a:b] for a, b in zip(of[:-1], of[1:])] * 3, np.tile(labels, 3))
    want = []
    for a, b in zip(of[:-1], of[1:]):
        own = model.rows[ids[a:b]]
        t = max(1, b - a - toxicity.PAD)
        pooled = [sum(parts[j][own[j : j + t]] for j in range(w)).max(0) for w, parts in model.tables.items()]
        hidden = np.maximum(np.concatenate(pooled) + model.bias, 0)
        want.append(1 / (1 + np.exp(-(hidden @ model.out + model.base))))
    assert np.allclose(model.scores(ids, of), want, atol=1e-6)


def test_threshold_separates():
    scores, labels = np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])
    assert toxicity.threshold(scores, labels) == 0.5
    assert 0.8 < toxicity.threshold(np.array([0.1, 0.8, 0.85, 0.9]), np.array([0, 0, 1, 1])) < 0.85


TEXTS = ["", "abcde", " \n", "x", "żółw 東京都  Ab-c", "é" * 40 + " 😀", "", "fgh\tabcde abcde"]


def buckets_by_loops(text):
    """Words, then n-grams of characters, each hashed alone."""
    out = []
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    for w in found:
        data = np.frombuffer(w.encode(), np.uint8)
        alone = words_of(data, np.array([0, len(data)]), NOT_SPACE, False)
        out.append(int(alone.hashes()[0]) % quality.WORD_BUCKETS)
    for size in quality.GRAMS:
        for i in range(len(text) - size + 1):
            code = size
            for ch in text[i : i + size]:
                code = (code * 0x9E3779B97F4A7C15 + int.from_bytes(ch.encode(), "big")) % (1 << 64)
            code = int(quality.mixed(np.array([code], np.uint64))[0])
            out.append(quality.WORD_BUCKETS + code % quality.GRAM_BUCKETS)
    return out


def test_features_are_words_and_character_ngrams_of_texts():
    raw = [t.encode() for t in TEXTS]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    words = words_of(np.frombuffer(b"".join(raw), np.uint8), bounds, NOT_SPACE, False)
    parts = list(quality.features(words))
    for d, text in enumerate(TEXTS):
        got = [b for buckets, of in parts for b in buckets[of[d] : of[d + 1]].tolist()]
        assert got == buckets_by_loops(text)
    none = words_of(np.zeros(0, np.uint8), np.array([0, 0]), NOT_SPACE, False)
    assert [(len(b), of.tolist()) for b, of in quality.features(none)] == [(0, [0, 0])] * (1 + len(quality.GRAMS))


def test_quality_scores_are_those_of_a_plain_forward_pass(spark, monkeypatch):
    """Mean of the features' vectors, softmax over both classes, from features by loops; the very long text too."""
    rows = [(k, t) for k, (_, t, *_) in enumerate(corpus(40))] + [(100 + k, t) for k, t in enumerate(TEXTS)] + [(200, "wö " * 90_000)]
    y = np.array([k % 2 for k, _ in rows])
    sparse = [tuple(np.unique(buckets_by_loops(t), return_counts=True)) for _, t in rows]
    sparse = [(b.astype(np.int64), n / max(1, n.sum())) for b, n in sparse]
    vectors, row_of, out, base = quality.trained(sparse, y)
    monkeypatch.setattr(quality, "learned", lambda docs, labels: quality.fit(sparse, y))
    got = {r.doc_id: r.score for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    for (k, t), (b, share) in zip(rows, sparse):
        logits = sum((s * vectors[row_of[x]] for x, s in zip(b, share)), np.zeros(quality.SIZE)) @ out + base
        p = np.exp(logits - logits.max())
        assert abs(got[k] - p[1] / p.sum()) < 1e-5


def test_words_do_not_depend_on_neighbours_or_length():
    text = "Ab-c  é9 " + "z" * 3_000_000 + " q"
    data = np.frombuffer(text.encode(), np.uint8)
    words = words_of(data, np.array([0, len(data)]), LETTERS, True)
    spelled = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
    assert spelled[:4] == ["ab", "c", "é9", "z" * 3_000_000]
    alone = words_of(np.frombuffer("é9".encode(), np.uint8), np.array([0, 3]), LETTERS, True)
    assert words.hashes()[2] == alone.hashes()[0]
