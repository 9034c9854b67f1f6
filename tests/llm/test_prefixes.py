import hashlib
import random
import zlib

import pytest

from specweave.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string"


@pytest.fixture
def talk(spark):
    def made(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)

    return made


def brute(rows):
    talks = {}
    for c, t, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    talks = {c: [(r[2], r[4]) for r in sorted(own)] for c, own in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(talks.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, own in rebuilt.items():
        for d in range(len(own) + 1):
            nodes.setdefault(own[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        parents = {k[:-1] for k in nodes if k}
        ends = sorted(c for c in members if rebuilt[c] == key)
        out.append(
            (
                min(members),
                len(key),
                min(nodes[key[:-1]]) if key else None,
                len(members),
                sum(len(k) == len(key) + 1 for k in below),
                sum(k not in parents for k in below),
                sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def some(rng, convs, longest=8):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bb", "é\n"])))
    return rows


@pytest.mark.parametrize(("span", "cells", "most"), [(4096, 1 << 15, 1 << 27), (2, 1 << 15, 1 << 15)])
def test_against_loops(talk, span, cells, most):
    rng = random.Random(span)
    rows = some(rng, [*range(40), *range(195, 330), 5000, None], 8)
    copies = [(t, r, x) for c, t, r, x in rows if c == 7]
    rows += [(c, *turn) for c in range(600, 640) for turn in copies]
    rows += [(5, 2, "user", "again")] * 3
    rows += [(c, t, "user", f"line {t % 3}") for c in (700, 701, 702) for t in range(60)]
    rng.shuffle(rows)
    got = prefixes.trie(talk(rows).repartition(5), span, cells, most)
    assert found(got) == brute(rows)


def test_turnless_and_empty(talk):
    # conversations that lose all their turns, as their first ones come from a conversation that is absent
    lost = [c for c in range(1001, 1099) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, t, "user", "x") for c in lost for t in range(2)]
    assert found(prefixes.trie(talk(rows))) == brute(rows)
    assert found(prefixes.trie(talk([*rows, (1000, 0, "user", "long " * 100_000)]))) == brute([*rows, (1000, 0, "user", "long " * 100_000)])
    assert prefixes.trie(talk([])).count() == 0
    assert prefixes.trie(talk([(None, 0, "user", "x")])).count() == 0


def test_only_shared_prefixes_are_grouped(talk, monkeypatch):
    rng = random.Random(3)
    rows = [(100 * c, t, "user", f"text {rng.random()}") for c in range(400) for t in range(5)]
    rows += [(100 * c, t, "user", "same") for c in (900, 901) for t in range(5)]
    grouped = []
    plain = prefixes._ends
    monkeypatch.setattr(prefixes, "_ends", lambda ends: grouped.append(ends.count()) or plain(ends))
    assert found(prefixes.trie(talk(rows))) == brute(rows)
    assert 2 <= grouped[0] < 40  # of 402 conversations
