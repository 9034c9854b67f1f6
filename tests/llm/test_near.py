import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import near
from specweave.llm.graph import components


def shingles(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((i, len(sets[k]), low, low is None or i == low))
    return sorted(out, key=str)


def made(rng):
    rows = []
    for _ in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = [f"v{rng.randint(0, 5000)}" if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append(" ".join(copy))
    hub = [f"h{k}" for k in range(200)]
    for k in range(60):  # copies of one text that are near it, but not always near each other
        copy = list(hub)
        for _ in range(4):
            copy[rng.randrange(200)] = f"x{k}"
        rows.append(" ".join(copy))
    rows += [" ".join(hub)] + [" ".join(hub).upper()] * 20
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [8, 128])
def test_as_brute_force(docs_of, odd, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = made(random.Random(block)) + [(i if i is None else -i, t) for i, t in odd]
    got = near.near_duplicates(docs_of(rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = near.representatives(docs_of(rows))
    assert kept.columns == docs_of([]).columns
    ids = {w[0] for w in brute(rows) if w[3] and w[0] is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == ids


def test_rows_without_id_go_or_stay_once(docs_of):
    words = [f"w{k}" for k in range(60)]
    text, near_one = " ".join(words), " ".join([*words[:59], "other"])
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(7, text), (None, text), (None, near_one), (None, other), (None, other), (None, f"{other} more"), (9, text)]
    rows += [(None, None), (None, None), (None, " "), (8, None)]
    kept = [(r.doc_id, r.text) for r in near.representatives(docs_of(rows).repartition(3)).collect()]
    alike = [k for k in kept if k[1] and k[1].startswith("v0")]
    assert len(alike) == 1 and alike[0][0] is None
    rest = [(7, text), (None, None), (None, None), (None, " "), (8, None)]
    assert sorted((k for k in kept if k not in alike), key=str) == sorted(rest, key=str)


def test_pairs_that_only_blocks_find(spark, docs_of, monkeypatch):
    """A chain in which neither the first nor the last class of a key is near all others."""
    monkeypatch.setattr(near, "BLOCK", 4)
    words = [f"c{k}" for k in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 120])) for k in range(60)]
    got = near.near_duplicates(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_signatures_below_the_distance_meet():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.integers(0, 1 << 16, near.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.choice(near.POSITIONS, near.MOST_APART, replace=False)] += 1
        keys = near.keys_of([a.tobytes(), b.tobytes()])
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_sets_of_long_texts():
    text = "word " * 600_000 + "end"
    ((_, (found,)),) = near.shingle_sets(pa.array([text]))
    assert len(found) == 2


def test_no_documents(docs_of):
    assert near.near_duplicates(docs_of([])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 500)]
    pairs += [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    group = {}
    for a, b in pairs:
        if a is None or a == b:
            continue
        both = group.get(a, {a}) | group.get(b, {b})
        for x in both:
            group[x] = both
    got = {(r.node, r.component) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, min(g)) for x, g in group.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
