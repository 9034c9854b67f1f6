"""Conversations repaired to ``(system? (user assistant)+)?`` by the cheapest edits.

The rows of a conversation are put in order by a range sort, so that a long one is spread over tasks, and cut
into segments of SPAN rows.  Each segment becomes a table of costs between the four states of the grammar;
tables of FAN segments join to one until one is left, and the states on the best way are handed down again
(:mod:`crossing`), to the single rows.  Only the digest of the repaired text is sequential by nature: one task
streams a conversation, in bounded memory but for the audit, which is a letter a row of the result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.crossing import FAR, STATES, Step, crossings, remembered, spanned
from specweave.llm.tables import stored

SPAN = 4096  # rows of a segment, a power of two
FAN = 1024  # segments joined at a time
TASK_ROWS = 1 << 18  # rows that a task solves, at about 20 microseconds each

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = STATES
INITIALS = "sua"
OTHER = len(INITIALS)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or changed role leads to
LAST = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # insertions after the last row
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1


def _moves(code: int) -> tuple[Step, list[list[str]]]:
    """A row as a step, and the letters of its cheapest edits from state to state."""
    initial, fault = code % 4, code // 4
    letters = [[""] * 4 for _ in STATES]
    costs = [[FAR] * 4 for _ in STATES]
    for p in STATES:
        ways: list[list[tuple[int, str]]] = [[] for _ in STATES]
        at = p
        for inserted in range(3):
            head, spent = "I" * inserted, INSERT * inserted
            ways[at].append((spent + DELETE, head + "D"))
            if fault not in (BLANK, DUPLICATE):
                left = CUT_OFF if fault == TRUNCATED else 0
                if (at, initial) in KEPT:
                    ways[KEPT[at, initial]].append((spent + left, head + "K"))
                ways[NEXT[at]].append((spent + left + REROLE, head + "R"))
            at = NEXT[at]
        for q in STATES:
            if ways[q]:
                costs[p][q], letters[p][q] = min(ways[q])
    ranks = [[sorted(row).index(w) if w else 0 for w in row] for row in letters]
    return (costs, ranks), letters


def _flat(step: Step) -> list[int]:
    return list(itertools.chain(*step[0], *step[1]))


def _step(flat: list[int]) -> Step:
    rows = [flat[4 * k : 4 * k + 4] for k in range(8)]
    return rows[:4], rows[4:]


Rows = Iterator[pa.RecordBatch]
_SPANNED = "conv_id {key}, part long, span array<long>, illegal long, first int, last int"
_ENDS = "conv_id {key}, part long, entry int, leave int"


def _arrow(batch: pa.RecordBatch, *columns: pa.Array) -> list[pa.Array]:
    return [batch.column("conv_id"), *columns]


def _of_rows() -> Callable[[Rows], Rows]:
    """Segments of rows as steps."""

    def run(batches: Rows) -> Rows:
        ahead, _ = remembered([_moves(code)[0] for code in range(16)])
        for batch in batches:
            spans, illegal = [], []
            codes = batch.column("codes").to_pylist()
            for row in codes:
                spans.append(_flat(spanned(row, ahead)))
                illegal.append(sum((a % 4, b % 4) not in LEGAL for a, b in itertools.pairwise(row)))
            firsts, lasts = [r[0] % 4 for r in codes], [r[-1] % 4 for r in codes]
            columns = (
                batch.column("part"),
                pa.array(spans, pa.list_(pa.int64())),
                pa.array(illegal, pa.int64()),
                pa.array(firsts, pa.int32()),
                pa.array(lasts, pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(_arrow(batch, *columns), ["conv_id", "part", "span", "illegal", "first", "last"])

    return run


def _of_spans() -> Callable[[Rows], Rows]:
    """Lists of neighbouring spans as one span."""

    def run(batches: Rows) -> Rows:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.column("spans").to_pylist():
                illegal = sum(s["illegal"] for s in row)
                illegal += sum((a["last"], b["first"]) not in LEGAL for a, b in itertools.pairwise(row))
                out.append((_flat(spanned([_step(s["span"]) for s in row])), illegal, row[0]["first"], row[-1]["last"]))
            types = (pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            names = ["conv_id", "part", "span", "illegal", "first", "last"]
            yield pa.RecordBatch.from_arrays(_arrow(batch, batch.column("part"), *columns), names)

    return run


def _of_ends() -> Callable[[Rows], Rows]:
    """Entry and exit of every span in a list, from those of the whole list."""

    def run(batches: Rows) -> Rows:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "spans", "entry", "leave")))
            out: list[tuple] = []
            for conv, row, entry, leave in rows:
                states = crossings([_step(s["span"]) for s in row], entry, leave)
                out += [(conv, s["part"], a, b) for s, (a, b) in zip(row, itertools.pairwise(states))]
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "entry", "leave"])

    return run


def _edits() -> Callable[[Rows], Rows]:
    """The letters of every row of a segment."""

    def run(batches: Rows) -> Rows:
        moves = [_moves(code) for code in range(16)]
        ahead, behind = remembered([m[0] for m in moves])
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "codes", "entry", "leave")))
            out: list[tuple] = []
            for conv, place, codes, entry, leave in rows:
                states = crossings(codes, entry, leave, ahead, behind)
                pairs = zip(codes, itertools.pairwise(states))
                out += [(conv, place + k, moves[c][1][a][b]) for k, (c, (a, b)) in enumerate(pairs)]
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.string())
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "place", "letters"])

    return run


class _Repaired:
    """A conversation as it streams by: digest and audit."""

    def __init__(self) -> None:
        self.sha, self.audit, self.state, self.lines = hashlib.sha256(), bytearray(), START, 0

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def row(self, letters: str, role: str, text: str) -> None:
        for letter in letters:
            if letter == "K":
                self.state = KEPT[self.state, INITIALS.index(role[0])]
                self.line(role, text)
            elif letter != "D":
                self.state = NEXT[self.state]
                self.line("user" if self.state == USER else "assistant", text if letter == "R" else "")
        self.audit += letters.encode()


def _digests() -> Callable[[Rows], Rows]:
    """Digest and audit of each conversation, whose edits and rows come sorted by place, edits first."""

    def run(batches: Rows) -> Rows:
        now, open_conv, letters = None, False, ""
        out: list[tuple] = []
        kind = None

        def closed() -> pa.RecordBatch:
            columns = [
                pa.array([o[0] for o in out], kind),
                pa.array([o[1].audit.decode() for o in out], pa.string()),
                pa.array([o[1].sha.hexdigest() for o in out], pa.string()),
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "letters", "role", "text")))
            for conv, place, written, role, text in rows:
                if not open_conv or conv != now:
                    now, open_conv = conv, True
                    out.append((conv, _Repaired()))
                if place is None:  # after the last row
                    out[-1][1].row(written, "", "")
                elif written is not None:
                    letters = written
                else:
                    out[-1][1].row(letters, role, text)
            if len(out) > 1024:
                last = out.pop()
                yield closed()
                out.append(last)
        if out:
            yield closed()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that the checksum of conversation and turn picks.

    Of crc32(``conv_id:turn``) modulo 20, 0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    the row and 4 makes its role ``user``.  Nulls are one space there, in roles and in texts.
    """

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    roll = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), roll.alias("roll")
    )
    text = F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("roll") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("roll") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where("roll <> 0").withColumn("time", F.explode(times))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``initial``, ``fault`` (but for duplicates) and a ``place`` that grows in the order of conversations.

    Within a task's range places have no gaps.  Rows of one turn come by role and digest of the text.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(*".!?"), NONE).otherwise(TRUNCATED)
    initial = F.lit(OTHER)
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.startswith("role", F.lit(letter)), k).otherwise(initial)
    digest = F.unhex(F.sha2("text", 256))
    rows = rows.withColumns({"digest": digest, "fault": fault, "initial": initial})
    order = ["conv_id", "turn", "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # stored, as another evaluation may draw other ranges
    return stored(ranged.withColumn("place", F.monotonically_increasing_id()))


def _segments(placed: DataFrame, span: int) -> DataFrame:
    """``conv_id, part, place, codes``: roles and faults of up to ``span`` rows in order; ``place`` is the first one's."""
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    firsts = firsts.select("place", F.lit(True).alias("first"))
    seen = F.col("first").isNull() & (F.col("fault") != BLANK)
    code = F.col("initial") + 4 * F.when(seen, DUPLICATE).otherwise(F.col("fault"))
    rows = placed.select("conv_id", "place", "initial", "fault").join(firsts, "place", "left")
    rows = rows.withColumn("code", F.struct("place", code.cast("int").alias("code")))
    cut = F.floor(F.col("place") / F.lit(span)).cast("long")
    parts = rows.groupBy("conv_id", cut.alias("cut")).agg(F.sort_array(F.collect_list("code")).alias("codes"))
    part = F.row_number().over(Window.partitionBy("conv_id").orderBy("cut")) - 1
    place, codes = F.col("codes")[0]["place"], F.col("codes")["code"]
    return stored(parts.select("conv_id", part.cast("long").alias("part"), place.alias("place"), codes.alias("codes")))


def _matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which a null conversation meets itself."""
    right = right.select(*(F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(right, same, how).drop(*(f"_{c}" for c in on))


def _lists(spans: DataFrame, fan: int) -> DataFrame:
    """Neighbouring spans, up to ``fan`` in a list."""
    span = F.struct("part", "span", "illegal", "first", "last")
    above = F.floor(F.col("part") / F.lit(fan)).cast("long")
    return spans.groupBy("conv_id", above.alias("part")).agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _spread(segments: DataFrame, rows: int) -> DataFrame:
    """Segments dealt by the work in them: their bytes are too few to tell."""
    session = segments.sparkSession
    least = int(session.conf.get("spark.sql.shuffle.partitions"))
    return segments.repartition(max(least, rows // TASK_ROWS), "conv_id", "part")


def _solved(segments: DataFrame, rows: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Entry and exit of every segment, and ``conv_id, illegal, cost, tail`` of every conversation."""
    key = segments.schema["conv_id"].dataType.simpleString()
    spanned_schema, ends_schema = _SPANNED.format(key=key), _ENDS.format(key=key)
    spans = stored(_spread(segments.select("conv_id", "part", "codes"), rows).mapInArrow(_of_rows(), spanned_schema))
    levels = []
    while spans.agg(F.max("part")).first()[0]:
        lists = stored(_lists(spans, fan))
        levels.append(lists)
        spans = stored(lists.mapInArrow(_of_spans(), spanned_schema))
    # of the states after the last row the cheapest, then the one with the least letters
    ways = F.array(
        *(
            F.struct(
                (F.col("span")[q] + INSERT * len(tail)).alias("cost"),
                F.col("span")[16 + q].alias("rank"),
                F.lit(q).alias("leave"),
                F.lit(tail).alias("tail"),
            )
            for q, tail in LAST.items()
        )
    )
    best = spans.select("conv_id", "part", "illegal", F.array_min(ways).alias("best"))
    whole = best.select("conv_id", "illegal", "best.cost", "best.tail")
    ends = best.select("conv_id", "part", F.lit(START).alias("entry"), "best.leave")
    for lists in reversed(levels):
        ends = stored(_matched(lists, ends, ["conv_id", "part"]).mapInArrow(_of_ends(), ends_schema))
    return ends, whole


def repaired(rows: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """Faults and cheapest repair of the conversations of ``rows`` (``conv_id, turn, role, text``), one row each.

    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  Rows stand by turn, nulls
    first, then by role and digest of the text.  The first fault of a row counts: blank, duplicate (role and
    text stand earlier in the conversation), truncated (no ``.!?`` at its end).  ``illegal`` counts neighbours
    whose roles do not begin with su, ua or au.  Edits are K(eep), R(erole), D(elete) and I(nsert); ``audit`` is
    the ASCII-least of the cheapest.  An empty role has no legal place.

    Null roles and texts count as empty, null conversations as one conversation, null turns have no part in
    ``gaps``.  Repeated rows are duplicates.  Other columns are not read; no rows give none.
    """
    rows = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    placed = _placed(rows)
    segments = _segments(placed, span)
    n = placed.count()
    ends, whole = _solved(segments, n, fan)
    key = segments.schema["conv_id"].dataType.simpleString()
    edits = _matched(segments, ends, ["conv_id", "part"]).select("conv_id", "part", "place", "codes", "entry", "leave")
    edits = _spread(edits, n).drop("part").mapInArrow(_edits(), f"conv_id {key}, place long, letters string")
    nothing = F.lit(None).cast("string")
    tails = whole.where("tail <> ''").select("conv_id", F.lit(None).cast("long").alias("place"), F.col("tail").alias("letters"))
    lines = edits.unionByName(tails).withColumns({"role": nothing, "text": nothing})
    lines = lines.unionByName(placed.select("conv_id", "place", nothing.alias("letters"), "role", "text"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("place"), F.desc_nulls_last("letters"))
    digests = lines.mapInArrow(_digests(), f"conv_id {key}, audit string, repaired_sha256 string")

    def faults(kind: int) -> Column:
        return F.sum(F.size(F.filter("codes", lambda c: F.floor(c / 4) == kind))).cast("long")

    kinds = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
    counts = segments.groupBy("conv_id").agg(*(faults(k).alias(name) for name, k in kinds.items()))
    turns = placed.select("conv_id", "turn").distinct().groupBy("conv_id")
    width = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    turns = turns.agg(F.coalesce(width, F.lit(0)).cast("long").alias("gaps"))
    out = _matched(_matched(turns, counts, ["conv_id"]), whole.drop("tail"), ["conv_id"])
    out = _matched(out, digests, ["conv_id"])
    return out.select("conv_id", "gaps", *kinds, "illegal", "cost", "audit", "repaired_sha256")


def repaired_after_damage(conversations: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """:func:`repaired` of :func:`damaged`, with a row of zeros for every conversation that lost all its rows.

    A null conversation is a conversation; repeated rows are damaged alike; an empty table gives no rows.
    """
    found = repaired(damaged(conversations), span, fan)
    out = _matched(conversations.select("conv_id").distinct(), found, ["conv_id"], "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.withColumns(zeros | empty)
