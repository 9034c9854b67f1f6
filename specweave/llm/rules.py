"""Quality rules learned as a decision list, in DataFrame operations only.

Statistics of every text are columns.  From those of a bounded sample of labelled rows a list of
threshold conjunctions is learned by sequential covering: a rule is grown condition by condition on one
part of the rows, pruned on the other, and what it covers is taken out before the next.  The list becomes
an ordered conditional expression over the columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.labels import labelled

SAMPLE = 4_000  # rows of each label
CUTS = 32  # thresholds tried for a statistic
MOST_CONDITIONS = 4
MOST_RULES = 24
LEAST_COVERED = 5
LEAST_PRECISION = 0.9

BLANK = r"[\x20\x09-\x0D]"
FEATURES = [
    "words",
    "chars_per_word",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "calls_per_word",
    "distinct_share",
    "words_per_line",
]


def _share(part: str, whole: str) -> Column:
    """Zero where there is nothing to share."""
    return F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)).cast("double")


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id``, the carried columns, counts and FEATURES of every text.

    Words are runs without white space.  ``n_repeat_words`` counts the words in windows of five that occur
    twice or more: windows are hashed (64 bits) and sorted with their places, so equal ones stand side by
    side; the places found, in order, give the words covered.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(c) for c in carried],
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumns(
        {
            "ws": F.array_remove(F.split("text", f"{BLANK}+"), ""),
            "ls": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long"),
            "n_calls": F.regexp_count("text", F.lit(r"[!?]")).cast("long"),
        }
    ).drop("text")
    rows = rows.withColumns(
        {
            "n_words": F.size("ws").cast("long"),
            "word_chars": F.length(F.array_join("ws", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("ws")),
            "n_lines": F.size("ls"),
            "n_dup_lines": (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"),
            "hashes": F.expr("if(size(ws) > 5, transform(sequence(1, size(ws) - 4), i -> xxhash64(slice(ws, i, 5))), array())"),
        }
    ).drop("ws", "ls")
    sorted_places = "if(size(array_distinct(hashes)) < size(hashes), sort_array(transform(hashes, (h, i) -> struct(h, i))), array())"
    rows = rows.withColumn("places", F.expr(sorted_places)).drop("hashes")
    rows = rows.withColumn(
        "same", F.expr("zip_with(places, slice(places, 2, greatest(size(places), 1)), (a, b) -> coalesce(a.h = b.h, false))")
    )
    rows = rows.withColumn("before", F.expr("concat(array(false), same)"))
    found = """sort_array(transform(
        filter(arrays_zip(places, same, before), z -> z.places.i is not null and (z.same or z.before)), z -> z.places.i))"""
    rows = rows.withColumn("found", F.expr(found)).drop("places", "same", "before")
    covered = """aggregate(zip_with(found, slice(found, 2, greatest(size(found), 1)), (a, b) -> least(5, coalesce(b - a, 5))),
        0, (n, x) -> n + x)"""
    rows = rows.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("found")
    return rows.withColumns(
        {
            "words": F.col("n_words").cast("double"),
            "chars_per_word": _share("word_chars", "n_words"),
            "symbols_per_word": _share("n_symbols", "n_words"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "repeat_share": _share("n_repeat_words", "n_words"),
            "upper_share": _share("n_upper", "word_chars"),
            "calls_per_word": _share("n_calls", "n_words"),
            "distinct_share": _share("n_distinct", "n_words"),
            "words_per_line": _share("n_words", "n_lines"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _candidates(rows: list) -> dict[Condition, int]:
    """Conditions at quantiles, each with the set of rows it covers as the bits of an integer."""
    out: dict[Condition, int] = {}
    for f in FEATURES:
        values = [r[f] for r in rows]
        known = sorted(set(values))
        between = [(a + b) / 2 for a, b in zip(known, known[1:])]
        if len(between) > CUTS:
            ordered = sorted(values)
            picked = sorted({ordered[len(ordered) * k // (CUTS + 1)] for k in range(1, CUTS + 1)})
            between = [(a + known[known.index(a) + 1]) / 2 for a in picked if a != known[-1]]
        for cut in between:
            low = sum(1 << i for i, v in enumerate(values) if v <= cut)
            out[Condition(f, False, cut)] = low
            out[Condition(f, True, cut)] = ((1 << len(rows)) - 1) ^ low
    return out


def _worth(bad: int, good: int) -> float:
    """How much better than chance a set of rows tells bad from good ones."""
    return math.log2((bad + 1) / (bad + good + 2))


def learn(rows: list) -> list[Rule]:
    """Rules, in order, for what label 0 marks; whatever no rule covers is kept.

    ``rows``: mappings with FEATURES and ``label``, in a fixed order.  Every third row prunes.
    """
    sets = _candidates(rows)
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, r in enumerate(rows) if r["label"] == 0)
    prune = sum(1 << i for i in range(0, len(rows), 3))
    left, rules = everything, []

    def counts(covered: int) -> tuple[int, int]:
        return (covered & bad).bit_count(), (covered & ~bad).bit_count()

    while len(rules) < MOST_RULES and (left & bad).bit_count() >= LEAST_COVERED:
        covered, rule = left & ~prune, []
        while len(rule) < MOST_CONDITIONS and covered & ~bad:
            p, n = counts(covered)
            before = _worth(p, n)
            gains = []
            for c, s in sets.items():
                q, m = counts(covered & s)
                if q >= LEAST_COVERED:
                    gains.append((q * (_worth(q, m) - before), str(c), c))
            best = max(gains, default=(0.0, "", None), key=lambda g: g[:2])
            if best[0] <= 1e-9:
                break
            rule.append(best[2])
            covered &= sets[best[2]]
        tries = []
        for size in range(1, len(rule) + 1):
            covered = left
            for c in rule[:size]:
                covered &= sets[c]
            p, n = counts(covered & prune)
            tries.append(((p - n) / (p + n) if p + n else -1.0, -size, covered))
        if not tries:
            break
        _, size, covered = max(tries, key=lambda t: t[:2])
        p, n = counts(covered)
        if p < LEAST_COVERED or p < LEAST_PRECISION * (p + n):
            break
        rules.append(tuple(rule[:-size]))
        left &= ~covered
    return rules


def learned(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The list learned from a bounded sample of rows labelled for quality; empty without both labels."""
    sample = statistics(labelled(docs, labels, "quality", per_class=SAMPLE), "label")
    rows = sorted(sample.select("doc_id", "label", *FEATURES).collect(), key=lambda r: r.doc_id)
    return learn(rows) if len({r.label for r in rows}) == 2 else []


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; 0 where none does."""
    out = None
    for i, rule in enumerate(rules):
        all_of = rule[0].column()
        for c in rule[1:]:
            all_of = all_of & c.column()
        out = F.when(all_of, i + 1) if out is None else out.when(all_of, i + 1)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule``.

    One row per input row.  A text of fewer than ten words, or with more than a fifth of its words in
    repeated windows, fails the base; others are kept unless a rule covers them.  Null and empty texts
    have no words and fail; repeated rows and rows without id stay rows of their own; other columns are
    not read.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = statistics(docs).select("doc_id", *counts, failed.alias("base_failed"), fired(rules).alias("rule"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
