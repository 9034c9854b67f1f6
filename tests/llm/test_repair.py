import hashlib
import heapq
import random
import zlib
from itertools import pairwise

import pytest

from specweave.llm import crossing, repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, codes int"
SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WORD = {"u": "user", "a": "assistant"}


@pytest.fixture
def talk(spark):
    def made(rows, schema=SCHEMA):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], schema)

    return made


def best_edits(rows):
    """Cheapest edits, then the least audit, of (role, text, fault) rows: a search over whole audits."""
    open_ways, done = [(0, "", 0, "", ())], set()
    while open_ways:
        cost, audit, k, last, out = heapq.heappop(open_ways)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(out)
        if (k, last) in done:
            continue
        done.add((k, last))
        for r in "ua":
            if (last, r) in GRAMMAR:
                heapq.heappush(open_ways, (cost + 2, audit + "I", k, r, (*out, f"{WORD[r]}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(open_ways, (cost + 3, audit + "D", k + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (last, role[:1]) in GRAMMAR:
                    heapq.heappush(open_ways, (cost + more, audit + "K", k + 1, role[0], (*out, f"{role}:{text}")))
                for r in "ua":
                    if (last, r) in GRAMMAR:
                        heapq.heappush(open_ways, (cost + 2 + more, audit + "R", k + 1, r, (*out, f"{WORD[r]}:{text}")))


def brute(rows, damage=True):
    out, convs = {}, {}
    for c, t, role, text in rows:
        convs.setdefault(c, [])
        if not damage:
            convs[c].append((t, role or "", text or ""))
            continue
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        roll = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if roll == 1:
            text = ""
        if roll == 2:
            text = "".join(x for x in text if x not in ".!?")
        convs[c] += [(t, "user" if roll == 4 else role, text)] * (0 if roll == 0 else 2 if roll == 3 else 1)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked = set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairwise(marked))
        cost, audit, text = best_edits(marked)
        out[c] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def some(rng, convs, longest):
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "bot"]
    texts = ["Yes.", "No!", "well", "", " \n", "Why?  ", None, "é.", "...", "a.b", "Yes. \x0b"]
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t, t + 3, None])
            rows.append((c, turn, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts) if rng.random() < 0.5 else f"text {c} {t}."))
    return rows


def test_crossing_against_search():
    rng = random.Random(4)
    faults = [None, "blank", "duplicate", "truncated"]
    looked_up = crossing.remembered([repair._moves(c)[0] for c in range(16)])
    for _ in range(3000):
        codes = [rng.randrange(16) for _ in range(rng.randint(1, 9))]
        moves = [repair._moves(c) for c in codes]
        steps = [m[0] for m in moves]
        cost, rank = crossing.spanned(steps)
        _, leave = min(((cost[0][q] + 2 * len(t), rank[0][q]), q) for q, t in repair.LAST.items())
        states = crossing.crossings(steps, 0, leave)
        assert crossing.crossings(codes, 0, leave, *looked_up) == states and crossing.spanned(codes, looked_up[0]) == (cost, rank)
        audit = "".join(m[1][a][b] for m, (a, b) in zip(moves, pairwise(states))) + repair.LAST[leave]
        want = best_edits([("suax"[c % 4] + "x", "t", faults[c // 4]) for c in codes])
        assert (cost[0][leave] + 2 * len(repair.LAST[leave]), audit) == want[:2]


@pytest.mark.parametrize(("span", "fan"), [(4096, 1024), (2, 2), (4, 3)])
def test_against_search(talk, span, fan):
    rng = random.Random(span)
    rows = some(rng, [*range(60), -3, None], 12) + some(rng, [777], 90)
    rows += rng.sample(rows, 60)  # repeated rows
    rng.shuffle(rows)
    got = repair.repaired_after_damage(talk(rows).repartition(5), span, fan)
    assert found(got) == brute(rows)
    assert found(repair.repaired(talk(rows), span, fan)) == brute(rows, damage=False)


def test_dropped_whole_and_empty(talk):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "x")]
    assert found(repair.repaired_after_damage(talk(rows))) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert repair.repaired_after_damage(talk([])).count() == 0
    assert repair.repaired(talk([])).count() == 0


def test_long_texts_and_a_long_conversation(talk):
    rows = [(1, 0, "user", "a" * 300_000), (1, 1, "assistant", "b. " * 100_000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(9000)]
    assert found(repair.repaired_after_damage(talk(rows).repartition(3), 256, 8)) == brute(rows)
