import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import lm


def words(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", text) + [""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def made(n=300, longest=60):
    rng = random.Random(1)
    pools = [[f"{a}{k}" for k in range(60)] for a in ("de", "Fra", "éng")]
    rows = []
    for i in range(n):
        pool = pools[i % 3]
        rows.append((i, " ".join(pool[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.randint(1, longest))) + f" rare{i}"))
    return rows


@pytest.mark.parametrize("vocabulary", [1 << 18, 20])
def test_counts_and_base_as_by_loops(docs_of, odd, monkeypatch, vocabulary):
    monkeypatch.setattr(lm, "VOCABULARY", vocabulary)
    monkeypatch.setattr(lm, "TOP_WORDS", min(lm.TOP_WORDS, vocabulary))
    rows = made(60) + [(i if i is None else i + 500, t) for i, t in odd]
    got = lm.scores(docs_of(rows).repartition(3)).collect()
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in own)
        want.append((i, held(i), len(own), sum(c[w] > 0 for w in own), total, round(base, 6)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert all(r.score < 0 for r in got)


def test_model_beats_the_base_on_held_out_texts(docs_of):
    got = lm.scores(docs_of(made(400, 500)).repartition(2)).collect()
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def by_loops(model, symbols, k):
    """The hidden vector before position ``k`` of a text: the end symbol stands before its start."""
    before = [symbols[k - 1 - j] if k > j else 0 for j in range(lm.CONTEXT)]
    return sum(model.words[s] * model.places[j] for j, s in enumerate(before))


def test_probabilities_sum_to_one(docs_of):
    known = lm.vocabulary(lm.word_counts(docs_of(made(80))).cache())
    assert known.total == sum(len(words(t)) for _, t in made(80))
    model = lm.Model.start(known.noise, known.rows, known.row_noise)
    ((_, texts),) = lm.coded(pa.array([t for _, t in made(5)] + [None]), known)
    hidden = np.array([by_loops(model, texts.symbols[a:b], k) for a, b in zip(texts.of[:-1], texts.of[1:]) for k in range(b - a)])
    logits = hidden @ model.targets[:, :-1].T + model.targets[:, -1]
    output, group, row = model.located(texts.symbols)
    share = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    want = np.log10(share[np.arange(len(output)), output])
    for i in np.flatnonzero(group >= 0):
        inner = model.inner[known.rows[group[i]] : known.rows[group[i] + 1]]
        inside = np.exp(inner[:, :-1] @ hidden[i] + inner[:, -1])
        want[i] += np.log10(inside[row[i] - known.rows[group[i]]] / inside.sum())
    assert (group >= 0).any() and (texts.symbols >= lm.OUTPUTS).any()
    assert np.allclose(model.log10(texts.symbols, texts.of), want, atol=1e-4)
    # within a group: all words that occur once (others are members) and one unseen word share the rest
    c = Counter(w for _, t in made(80) for w in words(t))
    top = {w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))[: lm.TOP_WORDS]}
    sums = Counter()
    for w, n in c.items():
        if w and w not in top and n == 1:
            data = np.frombuffer(w.encode(), np.uint8)
            group = lm.buckets_of(lm.words_of(data, np.array([0, len(data)]), lm.NOT_SPACE, False), np.array([0]))[0]
            sums[group] += n + 1
    for group, n in sums.items():
        assert math.isclose(10 ** known.group_logs[group], n + 1)


def test_contexts_do_not_cross_texts():
    run, at = lm.padded(np.array([5, 6, 0, 7, 0]), np.array([0, 3, 5]))
    got = run[at[:, None] - 1 - np.arange(lm.CONTEXT)]
    assert got[:, 0].tolist() == [0, 5, 6, 0, 7] and got[4].tolist() == [7] + [0] * (lm.CONTEXT - 1)
    assert run[at].tolist() == [5, 6, 0, 7, 0] and lm.padded(np.zeros(0, int), np.array([0]))[0].size == 0


def test_a_step_goes_down_the_gradient_of_the_plain_loss(monkeypatch):
    """One step against the same noise drawn again: every vector moves against a numeric derivative of the loss."""
    monkeypatch.setattr(lm, "NOISE", 4)
    rng = np.random.default_rng(3)
    rows = np.arange(lm.BUCKETS + 1) * 4
    known = lm.Vocabulary(*[np.zeros(0, np.int64)] * 3, 1, 1, 1, np.zeros(lm.OUTPUTS), rng.random(lm.OUTPUTS) + 0.1, rows, rng.random(rows[-1]) + 0.1)
    symbols = np.array([1, 1 + lm.TOP_WORDS, lm.OUTPUTS + 1, lm.OUTPUTS + 2, lm.OUTPUTS + 9, 5, 0])
    run, at = lm.padded(symbols, np.array([0, 7]))
    trainer = lm.Trainer(lm.Model.start(known.noise, rows, known.row_noise), known, 7)
    start = lm.Model.of(trainer.model.flat(), rows)
    moved = {}
    monkeypatch.setattr(trainer, "_move", lambda k, at, d: moved.update({k: (at, d.copy())}))
    trainer.step(run[None], at - lm.CONTEXT)
    again = np.random.default_rng(7)
    noise = np.minimum(np.searchsorted(trainer.below, again.random(4), "right"), lm.OUTPUTS - 1)
    output, group, row = start.located(symbols)
    kinds = sorted(set(group[group >= 0].tolist()))
    share = again.random((len(kinds), lm.GROUP_NOISE))
    drawn = {}
    for i, g in enumerate(kinds):
        low, high = trainer.row_below[rows[g]], trainer.row_below[rows[g + 1]]
        drawn[g] = np.clip(np.searchsorted(trainer.row_below, low + (high - low) * share[i], "right") - 1, rows[g], rows[g + 1] - 1)

    def loss(model):
        total = 0.0
        for k in range(len(symbols)):
            h = np.append(by_loops(model, symbols, k).astype(np.float64), 1)
            total += np.log1p(np.exp(-(h @ model.targets[output[k]] - trainer.log_noise[output[k]])))
            total += sum(np.log1p(np.exp(h @ model.targets[j] - trainer.log_noise[j])) for j in noise)
            if group[k] >= 0:
                total += np.log1p(np.exp(-(h @ model.inner[row[k]] - trainer.row_log_noise[row[k]])))
                total += sum(np.log1p(np.exp(h @ model.inner[j] - trainer.row_log_noise[j])) for j in drawn[group[k]])
        return total / len(symbols)

    for k, (places, d) in moved.items():
        places = np.arange(lm.CONTEXT) if isinstance(places, slice) else places
        for i in range(min(len(places), 6)):
            for column in (0, d.shape[1] - 1):
                values = []
                for sign in (1, -1):
                    model = lm.Model.of(start.flat().astype(np.float64), rows)
                    parts = [x.astype(np.float64) for x in model.trainable()]
                    parts[k][places[i], column] += sign * 1e-3
                    values.append(loss(lm.Model(*parts, rows)))
                assert math.isclose((values[0] - values[1]) / 2e-3, d[i, column], rel_tol=0.02, abs_tol=2e-4)
    assert set(moved) == {0, 1, 2, 3}


def test_no_training_rows_and_no_documents(docs_of):
    only = next(i for i in range(100) if held(i))
    (r,) = lm.scores(docs_of([(only, "a b a")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0.0)
    assert lm.scores(docs_of([])).count() == 0


def many(n=400):
    """Texts of more words than TOP_WORDS, each word followed by one that the word before it tells."""
    rng = random.Random(2)
    heads, tails = [f"h{k}{'aeiou'[k % 5]}" for k in range(300)], [f"t{k}{'aeiou'[k % 5]}" for k in range(300)]
    rows = []
    for i in range(n):
        at = [min(int(rng.expovariate(0.01)), 299) for _ in range(200)]
        rows.append((i, " ".join(f"{heads[k]} {tails[k]}" for k in at) + f" rare{i}"))
    return rows


def test_training_moves_every_word_that_occurs(docs_of):
    """All positions are targets: whatever symbol occurs has another bias after training, and noise alone is no reason."""
    rows = [(i, t) for i, t in many(40) if not held(i)]
    known = lm.vocabulary(lm.word_counts(docs_of(rows)).cache())
    before = lm.Model.start(known.noise, known.rows, known.row_noise)
    after = lm.trained(lm.codes(docs_of(rows).repartition(2), known), known)
    inner = known.symbols[known.symbols >= lm.OUTPUTS] - lm.OUTPUTS
    assert len(inner) and (before.inner[inner, -1] != after.inner[inner, -1]).all()
    assert (before.words[lm.OUTPUTS + inner] != after.words[lm.OUTPUTS + inner]).any(1).all()


def test_frequent_words_of_groups_are_symbols_and_all_probabilities_sum_to_one(docs_of):
    rows = many(60)
    known = lm.vocabulary(lm.word_counts(docs_of(rows)).cache())
    c = Counter(w for _, t in rows for w in words(t))
    inner = known.symbols[known.symbols >= lm.OUTPUTS]
    assert len(inner) == len(set(inner)) > 0
    assert (known.counts[known.symbols >= 0] > 0).all() and known.row_noise.min() > 0
    model = lm.Model.start(known.noise, known.rows, known.row_noise)
    ids = [*range(lm.OUTPUTS), *inner.tolist()]
    # the same context before each symbol
    symbols = np.array([s for k in ids for s in (7, k)])
    of = np.arange(0, len(symbols) + 1, 2)
    share = 10 ** model.log10(symbols, of)[1::2]
    assert math.isclose(share.sum(), 1, rel_tol=1e-4)
    # the rest of a group holds what is no member
    assert math.isclose(known.row_noise.sum(), sum(n + 1 for w, n in c.items() if w) - sum(
        n + 1 for n in sorted((n for w, n in c.items() if w), reverse=True)[: lm.TOP_WORDS]
    ) + lm.BUCKETS)


def test_production_model_beats_the_base_by_words_outside_the_top(docs_of):
    got = [r for r in lm.scores(docs_of(many()).repartition(2)).collect() if r.held_out]
    assert len({w for _, t in many() for w in words(t)}) > 2 * lm.TOP_WORDS
    assert sum(r.score for r in got) > 0.99 * sum(r.base_score for r in got)


def test_words_of_many_slices_are_counted_together(monkeypatch):
    class Table:  # takes what tasks would run
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *columns):
            return self

        agg = where = groupBy

    table = Table()
    monkeypatch.setattr(lm, "_texts", lambda docs: docs)
    monkeypatch.setattr(lm, "F", type("F", (), {"sum": staticmethod(lambda name: type("C", (), {"alias": lambda self, n: n})())}))
    lm.word_counts(table)
    texts = ["a b a" + " long" * 100_000] * 6 + [None, "c b"]
    for most in (1 << 24, 1):
        monkeypatch.setattr(lm, "COUNTED_BYTES", most, raising=False)
        got = [r for b in table.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 2)) for r in b.to_pylist()]
        found = Counter()
        for r in got:
            found[r["token"]] += r["n"]
        assert found == {"a": 24, "b": 14, "c": 2, "long": 1_200_000, "": 16}
        if most > 1:
            assert len(got) == 5  # a row a word, whatever the slices


def test_words_are_found_as_by_search():
    rng = np.random.default_rng(1)
    # many with the same first bits
    own = np.unique(np.concatenate((rng.integers(0, 1 << 64, 500, np.uint64, False), rng.integers(0, 99, 60, np.uint64), (1 << 64) - 1 - rng.integers(0, 99, 60).astype(np.uint64))))
    asked = np.concatenate((own, rng.integers(0, 1 << 64, 500, np.uint64, False), np.arange(120, dtype=np.uint64), ~np.arange(120, dtype=np.uint64)))
    for hashes in (own, own[:0]):
        known = lm.Vocabulary(hashes, np.arange(len(hashes)), np.arange(len(hashes)), *[None] * 7)
        place, hit = known.places(asked)
        assert hit.tolist() == np.isin(asked, hashes).tolist()
        assert (hashes[place[hit]] == asked[hit]).all()


@pytest.mark.parametrize("scale", [1, 60, 1e4])
@pytest.mark.parametrize("bias", [0, 30, -100, 500])
def test_shares_of_any_size(scale, bias):
    rng = np.random.default_rng(2)
    targets = rng.normal(0, 1, (50, lm.SIZE + 1)).astype(np.float32)
    targets[:, -1] += bias
    targets[::2, -1] -= bias / 2
    hidden = np.ones((lm.SIZE + 1, 700), np.float32)
    hidden[:-1] = rng.normal(0, scale / 16, (lm.SIZE, 700))
    at = rng.integers(0, 50, 700)
    logits = targets.astype(np.float64) @ hidden.astype(np.float64)
    top = logits.max(0)
    want = logits[at, np.arange(700)] - top - np.log(np.exp(logits - top).sum(0))
    assert np.allclose(lm._Outputs(targets).log_share(hidden, at), want, rtol=1e-5, atol=2e-4)
