import random

from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs_of, odd  # noqa: F401
from specweave.llm import lines


def passage(rng, n):
    return " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=25), st.lists(st.integers(0, 8), max_size=25))
def test_patience_is_an_alignment(a, b):
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_patience_finds_unique_lines_in_order():
    assert lines.patience(list("xaybzc"), list("aqbwc")) == [(1, 0), (3, 2), (5, 4)]
    assert lines.patience(list("abcabc"), list("abcabc")) == [(k, k) for k in range(6)]


def test_blocks_need_words_in_sum():
    assert lines.common_lines(list("abcd"), list("xbcy"), [9, 4, 5, 9], 10) == []
    assert lines.common_lines(list("abcd"), list("xbcy"), [9, 4, 6, 9], 10) == [1, 2]
    # two blocks that changed places are both found
    assert lines.common_lines(list("abxcd"), list("cdyab"), [9] * 5, 10) == [0, 1, 3, 4]


def test_later_documents_lose_common_blocks(docs_of, odd):
    rng = random.Random(1)
    a, b = passage(rng, 60), passage(rng, 55)
    own = [passage(rng, 20) for _ in range(12)]
    rows = [
        (10, f"{own[0]}\n{a}\n{own[1]}"),
        (11, f"{own[2]}\n{a}\n\n{own[3]}"),  # loses the passage, keeps the blank line
        (12, f"{own[4]}\n  {a.replace(' ', '  ')} \nshort one\n{own[5]}"),  # spacing does not count
        (13, f"{own[6]}\nshort one\n{own[7]}"),  # too short to count
        (14, f"{b}\n{own[8]}\n{a}"),
        (15, f"{a}\n{own[9]}\n{b}"),  # the passages in another order and from two documents
        (16, f"{own[0]}\n{a}\n{own[1]}"),  # an exact copy
        (None, f"{own[10]}\n{b}"),  # without id: later than all
        (17, f"{own[11]}\n{own[11]}"),  # repeats within one document are not looked for
    ]
    got = {(r.doc_id, r.text, r.n_cut) for r in lines.without_repeats(docs_of(rows + odd).repartition(4)).collect()}
    assert got >= {
        (10, rows[0][1], 0),
        (11, f"{own[2]}\n\n{own[3]}", 1),
        (12, f"{own[4]}\nshort one\n{own[5]}", 1),
        (13, rows[3][1], 0),
        (14, f"{b}\n{own[8]}", 1),
        (15, own[9], 2),
        (16, "", 3),
        (None, own[10], 1),
        (17, rows[8][1], 0),
        (1, None, 0),
        (2, "", 0),
        (4, "one", 0),
    }
    kept = lines.deduplicated(docs_of(rows + odd))
    assert kept.columns == docs_of([]).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 16 not in ids and sorted(map(str, ids)) == sorted(str(i) for i, _ in rows + odd if i != 16)
    assert lines.without_repeats(docs_of([])).count() == 0


def test_many_holders_make_one_link_each(docs_of):
    rng = random.Random(2)
    header, body = passage(rng, 12), passage(rng, 80)
    rows = [(k, f"{header}\n{passage(rng, 15)}\n{body}") for k in range(400)]
    got = sorted(lines.without_repeats(docs_of(rows).repartition(6)).collect())
    assert [r.n_cut for r in got] == [0] + [2] * 399
    assert all(r.text == rows[r.doc_id][1].split("\n")[1] for r in got[1:])


def test_every_shared_block_goes_once(docs_of):
    """Brute force: whatever line a document loses stands in an earlier one, and no long line is left twice."""
    rng = random.Random(3)
    pool = [passage(rng, rng.choice([3, 12, 30])) for _ in range(40)]
    rows = [(k, "\n".join(rng.choice([*pool, passage(rng, 8)]) for _ in range(rng.randint(1, 12)))) for k in range(150)]
    got = {r.doc_id: r for r in lines.without_repeats(docs_of(rows).repartition(5)).collect()}
    seen = set()
    for k, text in rows:
        before, after = text.split("\n"), got[k].text.split("\n") if got[k].text else []
        gone = list(before)
        for x in after:
            gone.remove(x)
        assert set(gone) <= seen
        assert not [x for x in after if len(x.split()) >= lines.MIN_WORDS and x in seen and before.count(x) == 1]
        seen |= set(before)


def gone_by_all(rows, min_words=lines.MIN_WORDS):
    """Brute force: the lines each document loses when it is held against all earlier ones."""
    out, texts = {}, [(k, text.split("\n")) for k, text in rows]
    for n, (k, own) in enumerate(texts):
        cut = set()
        for _, other in texts[:n]:
            for i in range(len(other)):
                for j in range(len(own)):
                    size = 0
                    while i + size < len(other) and j + size < len(own) and other[i + size] == own[j + size]:
                        size += 1
                    if sum(len(x.split()) for x in own[j : j + size]) >= min_words:
                        cut.update(range(j, j + size))
        out[k] = [x for j, x in enumerate(own) if j not in cut]
    return out


def test_blocks_of_short_lines_with_other_first_holders(docs_of):
    rng = random.Random(4)
    short = [passage(rng, 4) for _ in range(15)]
    rows = [(k, f"{x}\n{passage(rng, 12)}") for k, x in enumerate(short)]
    rows += [(20, "\n".join(short)), (21, f"{passage(rng, 12)}\n" + "\n".join(short))]
    # a long line whose first holder lacks the short one after it
    a, b = passage(rng, 10), passage(rng, 3)
    rows += [(22, a), (23, f"{passage(rng, 11)}\n{a}\n{b}"), (24, f"{a}\n{b}")]
    got = {r.doc_id: r for r in lines.without_repeats(docs_of(rows).repartition(3)).collect()}
    assert (got[20].n_cut, got[21].n_cut, got[23].n_cut, got[24].n_cut) == (0, 15, 1, 2)
    assert {k: r.text for k, r in got.items()} == {k: "\n".join(x) for k, x in gone_by_all(rows).items()}


def test_short_lines_as_against_all_earlier_documents(docs_of):
    rng = random.Random(5)
    pool = [passage(rng, rng.choice([1, 2, 3, 4, 5, 9, 10])) for _ in range(30)]
    rows = []
    for k in range(200):
        rng.shuffle(pool)
        rows.append((k, "\n".join(x for _, x in sorted(enumerate(pool[: rng.randint(1, 14)]), key=lambda x: x[1] if k % 2 else x[0]))))
    got = {r.doc_id: r.text for r in lines.without_repeats(docs_of(rows).repartition(3)).collect()}
    assert got == {k: "\n".join(x) for k, x in gone_by_all(rows).items()}


def test_only_what_is_aligned_is_cut(monkeypatch):
    pool = [f"line {k}" for k in range(80)]
    later = pool[40:] + ["own"] + pool[:40][::-1]
    sizes = [12] * len(later)
    assert lines.common_lines(pool, later, sizes, 10) == [j for j, x in enumerate(later) if x != "own"]
    plain = lines.patience
    monkeypatch.setattr(lines, "patience", lambda a, b: [p for p in plain(a, b) if b[p[1]] != ("line 50",)])
    assert lines.common_lines(pool, later, sizes, 10) == [j for j, x in enumerate(later) if x not in ("own", "line 50")]
    monkeypatch.setattr(lines, "patience", lambda a, b: [])
    assert lines.common_lines(pool, later, sizes, 10) == []


def test_a_very_long_text(docs_of):
    rng = random.Random(6)
    block = [passage(rng, 11) for _ in range(3000)]
    rows = [(1, "\n".join(block)), (2, "\n".join([*block[1500:], passage(rng, 12), *block[:1500]]))]
    rows += [(k, "\n".join(block[:40])) for k in range(3, 40)]
    got = {r.doc_id: r.n_cut for r in lines.without_repeats(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 3000} | {k: 40 for k in range(3, 40)}


def test_a_moved_block_may_begin_with_a_line_that_stands_earlier_too():
    assert lines.common_lines(list("xaxbcd"), list("cdxb"), [12, 12, 5, 5], 10) == [0, 1, 2, 3]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=20), st.lists(st.sampled_from("abcdef"), max_size=20))
def test_common_lines_are_all_common_blocks(a, b):
    words = dict(zip("abcdef", (1, 2, 4, 5, 9, 10)))
    rows = [(k, "\n".join(" ".join(x * words[x]) for x in own)) for k, own in enumerate((a, b))]
    left = gone_by_all(rows)[1]
    cut = set(lines.common_lines(a, b, [words[x] for x in b], 10))
    assert [" ".join(x * words[x]) for j, x in enumerate(b) if j not in cut] == (left if b else [])
