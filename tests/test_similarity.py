"""Kernels and top-k operators against brute force."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.functions.similarity import LetterSets, NameBlock, best, common, indel_ratio_of, lcs_length, matrix_of, rank_of
from specweave.operators import strings, vectors


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


TEXT = st.text(alphabet="abcdeé가_ 😀", max_size=150)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_lcs_length(a, b):
    assert lcs_length(a, b) == slow_lcs(a, b)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.lists(TEXT, min_size=1, max_size=6), st.integers(0, 10**6))
def test_name_block(length, queries, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdeé가_ 😀") for _ in range(rng.randint(1, length))) for _ in range(5)]
    block = NameBlock(names)
    everything = np.arange(len(names))
    for q in queries:
        assert list(block.lcs(q, everything)) == [slow_lcs(n, q) for n in names]
        cut = 0.7
        reach = set(block.reachable(q, cut))
        for i, n in enumerate(names):
            if 2 * slow_lcs(n, q) / (len(n) + len(q)) >= cut:
                assert i in reach


@pytest.mark.parametrize("kinds", ["abé가 😀", "".join(chr(0x4E00 + i) for i in range(900))])
def test_pairs_of_names(kinds):
    """LCS of pairs, and the bound by letters: exact for few kinds, never too low for many."""
    rng = random.Random(2)
    names, asked = (["".join(rng.choice(kinds) for _ in range(rng.randint(1, 150))) for _ in range(40)] for _ in "ab")
    block = NameBlock(names)
    i, j = (x.ravel() for x in np.indices((40, 40)))
    want = [slow_lcs(asked[a], names[b]) for a, b in zip(i, j)]
    assert list(block.lcs_pairs(block.rows(asked), i, j)) == want
    left, right = common(LetterSets(asked), LetterSets(names))
    shared = [sum(min(asked[a].count(ch), names[b].count(ch)) for ch in set(asked[a])) for a, b in zip(i, j)]
    bound = (left @ right).ravel()
    assert (bound >= shared).all() and (len(kinds) > 9 or (bound == shared).all())


def test_names_are_shuffled_once(spark):
    """A pair of names meets once, and no name is sent for each of its letters or each block of the other side."""
    texts = [f"host{i % 7}.example/{i * 7919 % 1000}" for i in range(300)]
    catalog = spark.createDataFrame([(t + "/x", t) for t in texts], "column_name string, column_id string")
    names = spark.createDataFrame([(t,) for t in texts], "eng_name string")
    found = strings.fuzzy_topk(names, catalog, 5, 0.7, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    met = strings._pairs(strings._wanted(names), strings._owners(catalog, 5), 5, 0.7, 20, lambda df: df)
    pairs = met.selectExpr("explode(q_rows) q", "rows").selectExpr("q.form", "explode(rows) r").selectExpr("form", "r.hit")
    assert pairs.count() == pairs.distinct().count()


def test_best_breaks_ties_by_rank():
    scores = np.array([0.5, 0.9, 0.9, 0.9, 0.1])
    ranks = rank_of(["e", "d", "b", "c", "a"])
    assert list(best(scores, ranks, scores >= 0.2, 2)) == [2, 3]
    assert list(best(scores, ranks, scores >= 0.95, 2)) == []


def test_matrix_of_marks_unusable_rows():
    column = pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0], [math.nan, 1.0], [1e300, 1e300]])
    units, good = matrix_of(column, 2)
    assert list(good) == [True, False, False, False, False, True]
    assert np.allclose(units[0], [0.6, 0.8]) and np.allclose(units[5], [0.5**0.5] * 2)


def test_token_sort_similarity(spark):
    df = spark.createDataFrame(
        [("red  widget", "widget red"), ("A_b", "b_A"), ("abc", None), ("Abc", "abc"), ("　a b ", "b a")],
        "a string, b string",
    )
    got = [r[0] for r in df.select(strings.token_sort_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, round(1 / 3, 4), None, round(4 / 6, 4), 1.0]


def brute_names(names, catalog, k, cut):
    out = []
    for name in sorted(set(names)):
        form = " ".join(sorted(name.split()))
        scored = []
        for cid, column in catalog:
            score = indel_ratio_of(form, " ".join(sorted(column.split())))
            if score >= cut:
                scored.append((-score, cid))
        for rank, (minus, cid) in enumerate(sorted(scored)[:k], 1):
            out.append((name, cid, round(-minus, 4), rank))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [3, 2048])
def test_fuzzy_topk_equals_brute_force(spark, rows, block_rows):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 70))) for _ in range(25)]
    catalog = [(f"c{i}", f"{rng.choice(words)} {rng.choice(words)}") for i in range(60)]
    # many columns of one name: the hot group
    catalog += [(f"h{i:02d}", "hot name") for i in range(30)]
    names = [rng.choice(catalog)[1][1:] or "x" for _ in range(40)] + ["hot nam", "name hot", "zzz"]
    cat = spark.createDataFrame(catalog, "column_id string, column_name string")
    ask = spark.createDataFrame([(n,) for n in names], "eng_name string")
    got = strings.fuzzy_topk(ask, cat, 5, 0.7, block_rows)
    assert rows(got) == sorted(brute_names(names, catalog, 5, 0.7))


@pytest.mark.parametrize("cut", [0.55, 0.7, 0.95])
def test_fuzzy_topk_on_long_and_alike_names(spark, rows, cut):
    rng = random.Random(11)
    catalog = [(f"n{i:03d}", f"Number#{i * 7919 % 100000:09d}") for i in range(150)]
    catalog += [(f"w{i}", "".join(rng.choice("abcdefgé가 ") for _ in range(rng.choice([1, 2, 9, 40, 300])))) for i in range(120)]
    catalog += [("e", ""), ("b", "  "), ("z", None)]
    names = [c[1:] + rng.choice(["", "q", "0"]) for _, c in rng.sample(catalog[:270], 60)] + ["Number#000000000", "", None]
    cat = spark.createDataFrame(catalog, "column_id string, column_name string")
    ask = spark.createDataFrame([(n,) for n in names], "eng_name string").repartition(3)
    want = brute_names([n for n in names if n and n.strip()], [c for c in catalog if c[1] and c[1].strip()], 4, cut)
    assert rows(strings.fuzzy_topk(ask, cat, 4, cut, 50)) == sorted(want)


def test_share_of_pairs_compared(spark):
    """Names meet only where they may be among the best: a share that falls as the names grow in number."""

    def share(sf, table, name, more):
        texts = spark.read.parquet(f"/root/testdata/{sf}/{table}.parquet").select(F.col(name).alias("t")).distinct()
        catalog = texts.select(F.concat("t", F.lit(more)).alias("column_name"), F.col("t").alias("column_id"))
        row = strings.fuzzy_effort(texts.select(F.col("t").alias("eng_name")), catalog).first()
        return row.n_compared / (row.n_forms * row.n_hits)

    # all pairs of customers' names reach the cut of 0.7
    assert share("sf0.1", "customer", "c_name", "x") < share("sf0.01", "customer", "c_name", "x") < 0.15
    assert share("sf0.1", "pages", "url", "/x") < share("sf0.01", "pages", "url", "/x") < 0.35


def test_fuzzy_topk_cases(spark, rows):
    pool = spark.createDataFrame(
        [("k7", "harbour_fee"), ("k8", "zinc ore, refined")],
        "column_id string, column_name string",
    )
    one = spark.createDataFrame([("harbor_fee",), ("qq",)], "eng_name string")
    assert rows(strings.fuzzy_topk(one, pool)) == [("harbor_fee", "k7", 0.9524, 1)]
    assert rows(strings.fuzzy_topk(one, pool.limit(0))) == []


def brute_vectors(queries, entries, limit, floor):
    out = []
    for qid, q in queries:
        scored = []
        for eid, e in entries:
            if not any(q) or not any(e) or len(q) != len(e):
                continue
            q64, e64 = np.asarray(q, np.float64), np.asarray(e, np.float64)
            sim = round(float(q64 @ e64 / np.linalg.norm(q64) / np.linalg.norm(e64)), 9)
            if floor is None or sim >= floor:
                scored.append((-sim, eid))
        out += [(qid, eid, round(-m, 6), r) for r, (m, eid) in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("floor", [None, 0.55, 0.9])
@pytest.mark.parametrize("block_rows,anchors", [(7, 9), (1024, 1)])
def test_vector_topk_equals_brute_force(spark, floor, block_rows, anchors):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    entries = [
        (f"e{i:03d}", [float(x) for x in centers[i % 6] + 0.3 * rng.normal(size=8)]) for i in range(90)
    ]
    entries += [(f"h{i:02d}", entries[0][1]) for i in range(40)]       # one hot vector
    entries += [("z0", [0.0] * 8), ("z1", [1.0] * 5)]                  # unusable
    queries = [
        (f"q{i:02d}", [float(x) for x in centers[i % 6] + 0.4 * rng.normal(size=8)]) for i in range(30)
    ]
    queries += [("same", entries[0][1]), ("zero", [0.0] * 8), ("short", [1.0])]
    q = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    e = spark.createDataFrame(entries, "entry_id string, embedding array<double>")
    found = vectors.vector_topk(q, e, 5, floor, anchors=anchors, dim=8, block_rows=block_rows).toPandas()
    got = sorted(
        (r.query_id, r.entry_id, round(r.similarity, 6), r.vector_rank) for r in found.itertuples()
    )
    assert sorted(got, key=str) == brute_vectors(queries, entries, 5, floor)


@pytest.mark.parametrize("floor", [None, 0.6])
def test_share_of_vector_pairs_multiplied(spark, floor):
    """In clusters most pairs do not meet, or are left out by the leading coordinates."""
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 48))
    rows = [(f"v{i:04d}", [float(x) for x in centers[i % 12] + 0.25 * rng.normal(size=48)]) for i in range(1200)]
    e = spark.createDataFrame(rows, "entry_id string, embedding array<double>")
    q = e.where("substr(entry_id, 5, 1) = '7'").withColumnRenamed("entry_id", "query_id")
    effort = vectors.vector_effort(q, e, 5, floor, anchors=30).first()
    pairs = q.count() * len(rows)
    assert effort.n_met < 0.6 * pairs and effort.n_compared < 0.15 * pairs
    found = vectors.vector_topk(q, e, 5, floor, anchors=30).toPandas()
    got = sorted((r.query_id, r.entry_id, round(r.similarity, 6), r.vector_rank) for r in found.itertuples())
    assert sorted(got, key=str) == brute_vectors([r for r in rows if r[0][4] == "7"], rows, 5, floor)


@pytest.mark.parametrize("block_rows", [5, 50])
def test_vectors_are_shuffled_once(spark, block_rows):
    """No row is sent once per block of the other side, however many blocks there are."""
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(f"e{i}", [float(x) for x in rng.normal(size=6)]) for i in range(300)], "entry_id string, embedding array<double>")
    found = vectors.vector_topk(e.withColumnRenamed("entry_id", "query_id"), e, 3, None, block_rows=block_rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    search = vectors._Search(e.withColumnRenamed("entry_id", "query_id"), e, 3, None, 4, None, block_rows, lambda df: df)
    assert search.entries.select(F.sum(F.size("ids"))).first()[0] == 300
    assert search.asked()[0].select(F.sum(F.size("q_ids"))).first()[0] == 300


def test_vector_topk_without_entries(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    e = spark.createDataFrame([("e", [0.0, 0.0])], "entry_id string, embedding array<double>")
    assert vectors.vector_topk(q, e, 3, 0.5).count() == 0


def test_cosine_expression(spark):
    df = spark.createDataFrame([([3.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_glossary_links(spark, rows):
    vec = "array<double>"
    catalog = spark.createDataFrame([("c1",), ("c2",)], "column_id string")
    terms = spark.createDataFrame(
        [("t1", "c1"), ("t2", None), ("t3", "gone")], "term_id string, linked_column_id string"
    )
    stored = spark.createDataFrame(
        [("t1", [1.0, 0.1]), ("t2", [1.0, 0.0]), ("t3", [1.0, 0.0])], f"term_id string, embedding {vec}"
    )
    q = spark.createDataFrame([("q", [1.0, 0.0])], f"query_id string, embedding {vec}")
    got = vectors.vector_topk_glossary(q, stored, terms, catalog, 2, 0.5)
    # the unlinked term is no candidate, the dangling one uses up the first place
    assert [(r.term_id, r.column_id, r.vector_rank) for r in got.collect()] == [("t1", "c1", 2)]


def test_self_similarity(spark, rows):
    e = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.2])], "entry_id string, embedding array<double>"
    )
    got = vectors.self_similarity_check(e)
    assert all(r.passed and r.first_id == r.entry_id and r.n_neighbours == 3 for r in got.collect())
    assert isinstance(got.toPandas(), pd.DataFrame)
