import pytest
from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import evaluate, judge, match

REPLY = "req_id long, response string"


def judged(spark, *responses, ids=("t7.price",)):
    df = spark.createDataFrame(list(enumerate(responses)), REPLY)
    ids_col = F.array(*[F.lit(x) for x in ids])
    out = judge.judge_guard(judge.judge_parse(df).withColumn("candidate_ids", ids_col))
    return [
        (r.selected_column_id, r.confidence, r.evidence, r.recommend_action, r.hallucination_flag)
        for r in out.orderBy("req_id").collect()
    ]


def test_valid_reply(spark):
    text = '{"selected_column_id":"t7.price","confidence":0.96,"evidence":"e","recommend_action":"auto_confirm"}'
    fenced = f"```json\n{text}\n```"
    want = ("t7.price", 0.96, "e", "auto_confirm", False)
    assert judged(spark, text, fenced, f"  {text}\n") == [want] * 3


def test_defaults_clamping_and_text_numbers(spark):
    got = judged(
        spark, "{}", '{"confidence":2.5,"selected_column_id":"t7.price"}', '{"confidence":-2}', '{"confidence":"0.5"}'
    )
    assert [g[1] for g in got] == [0.0, 1.0, 0.0, 0.5]
    assert got[0] == (None, 0.0, "", "human_confirm", False)


@pytest.mark.parametrize(
    "bad",
    ["not json", "[1]", "null", "3", '{"a":1} and more', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"confidence":"high"}',
     '{"confidence":NaN}', "{'confidence':0.9}", '{"confidence":0.9', "", '{"confidence":{"x":1}}', "```{}```x"],
)
def test_bad_replies_go_to_a_person(spark, bad):
    assert judged(spark, bad) == [(None, 0.0, M.EV_BAD_RESPONSE, "human_confirm", False)]


def test_selection_outside_the_list(spark):
    got = judged(spark, '{"selected_column_id":"t9.gone","confidence":0.98,"evidence":"e","recommend_action":"auto_confirm"}')
    assert got == [(None, 0.0, "e" + M.EV_OUTSIDE_SUFFIX, "human_confirm", True)]


@pytest.mark.parametrize(
    "confidence,attempt,want",
    [(0.92, 0, "auto_confirm"), (0.9199, 0, "retry"), (0.81, 1, "retry"), (0.81, 2, "human_confirm"),
     (0.70, 0, "retry"), (0.69, 0, "human_confirm"), (1.0, 2, "auto_confirm")],
)
def test_route(spark, confidence, attempt, want):
    one = spark.range(1).select(judge.route(F.lit(confidence), F.lit(attempt), F.lit("c")).alias("r"))
    assert one.first().r == want


def test_sure_without_selection_goes_to_a_person(spark):
    none = F.lit(None).cast("string")
    assert spark.range(1).select(judge.route(F.lit(0.96), F.lit(0), none).alias("r")).first().r == "human_confirm"


def test_retry_params(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (2,), (5,)], "attempt int")
    assert rows(judge.retry_params(df)) == [
        (0, 5, 0.75, False), (1, 8, 0.65, True), (2, 11, 0.55, True), (5, 20, 0.55, True),
    ]


def hits(spark, *data):
    return spark.createDataFrame(list(data), "ask_id string, column_id string, source string, score double, place int")


def test_merge_prefers_vectors_and_earlier_sources(spark, rows):
    df = hits(
        spark,
        ("q", "a", "vss_column", 0.80001, 1), ("q", "a", "vss_glossary", 0.80004, 1),   # equal at 4 decimals
        ("q", "b", "vss_glossary", 0.9, 1), ("q", "b", "vss_column", 0.85, 2),
        ("q", "c", "vss_column", 0.76, 3), ("q", "c", "fuzzy", 1.0, 1),                 # vector stays
        ("q", "d", "fuzzy", 0.72, 2),                                                   # under the first floor
        ("q", "e", "vss_column", 0.60, 4),
    )
    got = [tuple(r) for r in match.candidate_merge(df).orderBy("attempt", "rank").collect()]
    first = [("q", 0, "b", "vss_glossary", 0.9, 1), ("q", 0, "a", "vss_column", 0.8, 2), ("q", 0, "c", "vss_column", 0.76, 3)]
    assert got[:3] == first
    assert [(g[2], g[1]) for g in got[3:]] == [(c, 1) for c in "bacd"] + [(c, 2) for c in "bacde"]


def test_limits_of_each_attempt(spark):
    df = hits(spark, *[("q", f"c{i:02d}", "vss_column", 0.9 - i / 1000, i) for i in range(1, 23)])
    counts = {r.attempt: r.n for r in match.candidate_merge(df).groupBy("attempt").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 5, 1: 8, 2: 11}


def test_widening_stops_at_the_first_answer(spark, rows):
    rows_df = spark.createDataFrame(
        [("s", i, f"q{i}") for i in range(6)], "spec_id string, row_idx long, ask_id string"
    )
    found = [(f"q{i}", a, "c1", "fuzzy", 0.8, 1) for i in range(5) for a in range(3)]
    candidates = spark.createDataFrame(
        found, "ask_id string, attempt int, column_id string, source string, score double, rank int"
    )

    def reply(c):
        return f'{{"selected_column_id":"c1","confidence":{c},"evidence":"e"}}'

    responses = spark.createDataFrame(
        [
            ("s", 0, 0, reply(0.96)), ("s", 0, 1, reply(0.1)),
            ("s", 1, 0, reply(0.8)), ("s", 1, 1, reply(0.93)),
            ("s", 2, 0, reply(0.8)), ("s", 2, 1, reply(0.8)), ("s", 2, 2, reply(0.8)),
            ("s", 3, 0, reply(0.2)),
            ("s", 4, 0, reply(0.8)),
        ],
        "spec_id string, row_idx long, attempt int, response string",
    )
    got = judge.retry_widening(rows_df, candidates, responses).select("row_idx", "attempt", "route")
    assert rows(got) == [
        (0, 0, "auto_confirm"), (1, 1, "auto_confirm"), (2, 2, "human_confirm"), (3, 0, "human_confirm"),
        (4, 1, "awaiting_judgment"), (5, 0, "no_match"),
    ]


def test_confirmation(spark, rows):
    waiting = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "spec_id string, row_idx long")
    answers = spark.createDataFrame(
        [("s", 1, "approved"), ("s", 2, "no idea")], "spec_id string, row_idx long, decision string"
    )
    assert rows(judge.apply_confirmation(waiting, answers).select("row_idx", "match_status", "confirmation_status")) == [
        (1, "inferred_confirmed", "approved"), (2, "unresolved", "rejected"), (3, "pending", "pending"),
    ]
    assert rows(judge.confirmation_queue(waiting, answers)) == [("s", 3)]


def test_last_tag_write_wins(spark, rows):
    catalog = spark.createDataFrame(
        [("a", "old", 0.1, None), ("b", "keep", 0.2, None)],
        "column_id string, tag string, confidence double, updated_at timestamp",
    )
    writes = spark.createDataFrame(
        [("a", "one", 1.0, None, 0, "s", 9), ("a", "two", 1.0, None, 1, "s", 1), ("a", "three", None, None, 1, "s", 2)],
        "column_id string, tag string, confidence double, updated_at timestamp, stage int, spec_id string, row_idx long",
    )
    done = judge.tag_upsert(catalog, writes, ["stage", "spec_id", "row_idx"])
    assert rows(done.select("column_id", "tag", "confidence")) == [("a", "three", None), ("b", "keep", 0.2)]


def test_selected_candidate_and_requests(spark, rows):
    c = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "ask long, column_id string, rank int")
    j = spark.createDataFrame([(1, "y"), (1, "z"), (1, None), (2, "x")], "ask long, selected_column_id string")
    got = match.selected_candidate(j, c, ["ask"])
    assert rows(got) == [(1, None, "x"), (1, "y", "y"), (1, "z", "x"), (2, "x", None)]


def test_eval_rates(spark, rows):
    catalog = spark.createDataFrame([("1", "line_count")], "column_id string, column_name string")
    asked = spark.createDataFrame([("line_count",), (" line_count ",), ("lin_count",), ("zzz",)], "eng_name string")
    assert rows(evaluate.eval_coverage(asked, catalog)) == [(4, 0.5, 0.25)]
    assert rows(evaluate.eval_coverage(asked.limit(0), catalog)) == [(0, None, None)]


def test_last_writes_of_tasks_are_few(spark, rows):
    """What is sorted grows with the columns, not with the writes; nulls come first, as in Spark."""
    kind = "column_id string, tag string, confidence double, updated_at timestamp, stage int, spec_id string, row_idx long"
    given = [(f"c{k % 7}", f"t{k}", k / 10, None, k % 3 if k % 5 else None, None if k % 4 else f"s{k % 11}", k) for k in range(3000)]
    writes = spark.createDataFrame([*given, (None, "t", 0.5, None, 1, "s", 1)], kind).repartition(3)
    order = ["stage", "spec_id", "row_idx"]
    assert judge.last_writes(writes, order).count() <= 7 * 3
    catalog = spark.createDataFrame([(f"c{k}", "old", 0.1, None) for k in range(9)], "column_id string, tag string, confidence double, updated_at timestamp")
    last = {}
    for c, tag, confidence, _, *key in sorted(given, key=lambda g: [(x is not None, x or 0) if i != 1 else (x is not None, x or "") for i, x in enumerate(g[4:])]):
        last[c] = (c, tag, confidence, None)
    want = [last.get(f"c{k}", (f"c{k}", "old", 0.1, None)) for k in range(9)]
    assert rows(judge.tag_upsert(catalog, writes, order)) == sorted(want, key=str)


def test_ends_of_replies_are_cut_without_patterns(spark):
    out = judge.judge_parse(spark.createDataFrame([(1, " \t\x0b{}\f\r\n")], REPLY))
    # only the two steps of a code fence are patterns
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2
