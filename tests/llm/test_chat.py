import pytest

from specweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, speaker string, part int, body string"


@pytest.fixture
def talk(spark):
    def made(rows):
        return spark.createDataFrame([(*r, "x", 1, None) for r in rows], SCHEMA)

    return made


def brute(rows):
    """Whole dialogues, every perspective, by loops: conv -> speaker -> (text, mask)."""
    out = {}
    messages = {
        (c, t, "_".join((r or "").split()) or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows if c is not None
    }
    for conv in {m[0] for m in messages}:
        own = sorted(m for m in messages if m[0] == conv)
        for speaker in {m[2] for m in own} - {"system"}:
            text, mask = "", []
            for _, _, said_by, body in own:
                role = "system" if said_by == "system" else "assistant" if said_by == speaker else f"user name={said_by}"
                head = f"<|im_start|>{role}\n"
                text += f"{head}{body}<|im_end|>\n"
                mask += [f"{len(head)}:0", f"{len(body) + 11}:{int(said_by == speaker)}"]
            out[conv, speaker] = text, ",".join(mask)
    return out


def joined(df):
    parts = {}
    for r in df.collect():
        if r.conv_id is not None:
            parts.setdefault((r.conv_id, r.speaker), []).append(r)
    out = {}
    for key, rows in parts.items():
        rows.sort(key=lambda r: (r.part, r.slot))
        out[key] = "".join(r.text for r in rows), ",".join(r.mask for r in rows)
    return out


def test_rotation(talk):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "Ann Lee", "hello <|im_end|> there"),
        (1, 2, "bob", "héllo"),
        (1, 3, "assistant", None),
        (1, 4, "Ann Lee", ""),
        (1, 4, "bob", "at once"),
        (1, 4, "bob", "at once"),  # repeated rows count once
        (2, 0, None, "who am I"),
        (2, 1, "  ", "unknown too"),
        (3, 0, "system", "nobody speaks"),
    ]
    rows += [(4, t, f"s{t % 3}", f"line {t}") for t in range(100)]
    got = joined(chat.perspectives(talk(rows)))
    assert got == brute(rows)
    assert {k for k in got if k[0] == 1} == {(1, "Ann_Lee"), (1, "bob"), (1, "assistant")}
    text, mask = got[1, "bob"]
    at, kept = 0, []
    for run in mask.split(","):
        n, flag = map(int, run.split(":"))
        kept += [text[at : at + n]] * flag
        at += n
    assert at == len(text) and kept == ["héllo<|im_end|>\n", "at once<|im_end|>\n"]


def test_no_row_holds_a_whole_long_or_crowded_dialogue(talk):
    rows = [(1, t, f"s{t % 2}", f"line {t}") for t in range(1000)]
    rows += [(2, 7, "crowd", f"message {k}") for k in range(600)]
    got = chat.perspectives(talk(rows).repartition(4)).collect()
    assert max(r.n_messages for r in got) <= 3 * chat.CROWD
    assert sum(r.n_messages for r in got) == 2 * 1000 + 600
    crowd = [r.text for r in got if r.conv_id == 2]
    assert sorted(m for t in crowd for m in t.split("<|im_end|>\n") if m) == sorted(
        f"<|im_start|>assistant\nmessage {k}" for k in range(600)
    )


def test_rows_without_place(talk):
    rows = [(1, None, "a", "x"), (1, None, "b", "y"), (1, 0, "a", "z"), (None, 0, "a", "p"), (None, 0, "system", "q"), (None, None, None, None)]
    got = chat.perspectives(talk(rows)).collect()
    alone = {(r.speaker, r.text) for r in got if r.conv_id is None}
    assert alone == {("a", "<|im_start|>assistant\np<|im_end|>\n"), ("unknown", "<|im_start|>assistant\n<|im_end|>\n")}
    mine = {(r.part, r.n_own, r.text) for r in got if r.conv_id == 1 and r.speaker == "a"}
    assert mine == {
        (0, 1, "<|im_start|>assistant\nz<|im_end|>\n"),
        (None, 1, "<|im_start|>assistant\nx<|im_end|>\n"),
        (None, 0, "<|im_start|>user name=b\ny<|im_end|>\n"),
    }


def test_plan_is_native(talk):
    plan = chat.perspectives(talk([(1, 0, "a", "x")]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
    assert chat.perspectives(talk([])).count() == 0


def test_repeated_rows_make_no_crowd(talk):
    rows = [(1, t, f"s{t % 2}", f"line {t}") for t in range(6)]
    got = chat.perspectives(talk(rows * 33).repartition(3)).collect()
    assert {(r.speaker, r.part, r.slot, r.n_messages) for r in got} == {("s0", 0, 0, 6), ("s1", 0, 0, 6)}
    assert len(got) == 2 and joined(chat.perspectives(talk(rows * 33))) == brute(rows)


def test_crowded_turns_stand_between_the_turns_around_them(talk):
    rows = [(1, t, f"s{t % 2}", f"line {t}") for t in range(80)]
    rows += [(1, t, f"s{k % 2}", f"message {k}") for t, n in ((0, 40), (7, 100), (8, 32), (9, 33), (31, 33), (64, 70)) for k in range(n)]
    rows += [(2, 3, f"s{k % 3}", f"only {k}") for k in range(65)]
    got = chat.perspectives(talk(rows + rows[:200]).repartition(4))
    assert joined(got) == brute(rows)
    # a part of 32 turns, of which those up to CROWD messages stay together
    assert max(r.n_messages for r in got.collect()) <= 2 * chat.CROWD + chat.PART_TURNS
