import random
import re
from collections import Counter

from llm_fixtures import docs_of  # noqa: F401
from specweave.llm import rules


def counted(text):
    """The statistics by plain loops."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def texts():
    rng = random.Random(6)
    made = [None, "", " \n ", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e", "é ü #*\n\n#*\n", "x\ny\nx\n x"]
    made += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 25))) for _ in range(150)]
    made += ["\n".join(rng.choice(["a b", "c", "", "#|>", " "]) for _ in range(rng.randint(0, 9))) for _ in range(50)]
    return [*made, "w1 w2 w3 w4 w5 w6 " * 20_000]


def test_statistics_as_by_loops(docs_of):
    rows = list(enumerate(texts())) + [(None, "a b"), (0, None)]
    got = rules.judged(docs_of(rows).repartition(4), []).collect()
    want = sorted(((i, *counted(t)) for i, t in rows), key=str)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed) and r.rule == 0


def sample(rng, n=600):
    """Bad rows: many symbols, or many capitals in short words."""
    out = []
    for _ in range(n):
        r = {f: rng.random() for f in rules.FEATURES}
        r["label"] = int(not (r["symbols_per_word"] > 0.8 or (r["upper_share"] > 0.7 and r["chars_per_word"] < 0.4)))
        out.append(r)
    return out


def test_rules_are_found():
    rng = random.Random(8)
    found = rules.learn(sample(rng))
    assert found and all(len(r) <= rules.MOST_CONDITIONS for r in found)
    fresh = sample(rng)

    def covered(r):
        return any(all((r[c.feature] > c.cut) == c.above for c in rule) for rule in found)

    right = sum(covered(r) == (r["label"] == 0) for r in fresh)
    assert right / len(fresh) > 0.95
    assert found == rules.learn(sample(random.Random(8)))


def test_nothing_to_learn():
    rng = random.Random(9)
    rows = sample(rng, 90)
    for r in rows:
        r["label"] = 1
    assert rules.learn(rows) == []


def test_list_as_expression(spark):
    low, high = rules.Condition("words", False, 3.0), rules.Condition("upper_share", True, 0.5)
    df = spark.createDataFrame([(1.0, 0.1), (9.0, 0.9), (9.0, 0.1), (2.0, 0.9)], "words double, upper_share double")
    assert [r[0] for r in df.select(rules.fired([(high, low), (high,), (low,)])).collect()] == [3, 2, 0, 1]


def test_learned_from_tables_and_native(spark, docs_of):
    rng = random.Random(3)
    good = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40))) for k in range(200)]
    bad = [(1000 + k, " ".join(f"w{rng.randint(0, 10**6)}#" for _ in range(40))) for k in range(200)]
    docs = docs_of(good + bad + [(5000, None)])
    marks = spark.createDataFrame([(i, 1) for i, _ in good[:150]] + [(i, 0) for i, _ in bad[:150]], "doc_id long, quality int")
    found = rules.learned(docs, marks)
    out = rules.judged(docs, found)
    assert {r.doc_id for r in out.collect() if r.kept} == {i for i, _ in good}
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert rules.judged(docs_of([]), found).count() == 0
