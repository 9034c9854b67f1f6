import hashlib
import random
import re

import pytest

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import contamination as c


def words(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        own, hit, found = words(t), set(), set()
        for item, text in items:
            w = words(text)
            size = min(len(w), window)
            if item is None or not size:
                continue
            grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            for k in range(len(own) - size + 1):
                if tuple(own[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((i, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made():
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)]
    items += [(20, None), (21, ""), (None, "a b c a b c a b c a b c"), (5, items[5][1]), (30, "Zx-Yw zx/zx zx zx zx zx zx zx zx zx zx zx")]
    rows = []
    for i in range(120):
        parts = [rng.choice(["Q", "r7", "a", "B", "c", "É"]) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0 and items[i % 12][1]:
            w = items[i % 12][1].split()
            k = rng.randint(0, len(w) - 1)
            parts[rng.randint(0, len(parts)) :] = w[k : k + rng.randint(1, 20)]
        rows.append((i, rng.choice([" ", "-", "\n", ". "]).join(parts)))
    return rows + [(200, "zx " * 40), (201, "yw zx zx zx zx zx zx zx zx zx zx zx")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_as_brute_force(spark, docs_of, odd, block_bytes):
    rows, items = made()
    rows += odd
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = c.contamination(docs_of(rows).repartition(3), benchmark, block_bytes=block_bytes)
    want = brute(rows, items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    clean = c.clean(docs_of(rows), benchmark, block_bytes=block_bytes)
    assert clean.columns == docs_of([]).columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((w[0] for w in want if not w[5]), key=str)


def test_long_text_and_empty_tables(spark, docs_of):
    passage = " ".join(f"w{k}" for k in range(30))
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = "x " * 700_000 + passage + " y" * 700_000
    (row,) = c.contamination(docs_of([(1, long)]), benchmark).collect()
    assert (row.n_words, row.n_hit, row.n_items) == (1_400_030, 30, 1)
    assert c.contamination(docs_of([]), benchmark).count() == 0
    nothing = c.contamination(docs_of([(1, passage)]), benchmark.limit(0))
    assert [tuple(r)[1:4] for r in nothing.collect()] == [(30, 0, 0)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 10])
def test_items_without_id_mark_words_too(spark, docs_of, block_bytes):
    rng = random.Random(6)
    a, b, e = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(3))
    benchmark = spark.createDataFrame([(None, a), (None, b), (7, e), (7, a)], "item_id long, text string")
    rows = [(1, f"x {b} y"), (2, f"{a} {e}"), (3, "x y z"), (4, f"{a} {b}")]
    got = {r.doc_id: r for r in c.contamination(docs_of(rows), benchmark, block_bytes=block_bytes).collect()}
    sha = {k: hashlib.sha256(k.encode()).hexdigest() for k in ("", "7")}
    assert {k: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == {
        1: (12, 1, sha[""], True),
        2: (24, 2, sha["7"], True),
        3: (0, 0, sha[""], False),
        4: (24, 2, sha["7"], True),
    }
    assert [r.doc_id for r in c.clean(docs_of(rows), benchmark, block_bytes=block_bytes).collect()] == [3]


def test_passage_of_many_documents_and_long_words(spark, docs_of):
    """Hot fingerprints, words given by their digest, and words that differ only far behind."""
    long = "x" * 5_000
    passage = " ".join([*(f"w{k}" for k in range(6)), long, *(f"v{k}" for k in range(6))])
    benchmark = spark.createDataFrame([(k, f"{passage} u{k}") for k in range(5)] * 3, "item_id long, text string")
    rows = [(i, f"{'a' * (i % 7 + 1)} {passage} b{i % 5}") for i in range(400)] + [(400 + i, passage.replace(long, long + "y")) for i in range(50)]
    rows += [(i, "B C d") for i in range(450, 500)]
    assert sorted(map(tuple, c.contamination(docs_of(rows).repartition(7), benchmark).collect()), key=str) == brute(rows, [(r.item_id, r.text) for r in benchmark.distinct().collect()])
    assert sorted(r.doc_id for r in c.clean(docs_of(rows), benchmark).collect()) == list(range(400, 500))


def test_benchmark_stays_off_the_driver(spark, docs_of):
    """Fingerprints meet in a join, and the screen keeps its size."""
    rows, items = made()
    prints = c._item_prints(spark.createDataFrame(items * 4, "item_id long, text string"), c.WINDOW, c.K)
    assert c._screen(prints, 1 << 10).nbytes == 1 << 10 and c._screen(prints, 1).nbytes == 8
    found = c._doc_prints(docs_of(rows), prints, c.WINDOW, c.K, 1 << 10)
    plan = c._spans(found, prints, c.WINDOW, c.K)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan
    assert "text" not in found.columns
