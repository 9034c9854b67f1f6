import datetime
import json
import os
from collections import Counter

from pyspark.sql import functions as F

from specweave import model as M
from specweave.operators import catalog as cat
from specweave.operators import events as ev
from specweave.operators import glossary as G
from specweave.operators import match, numbering
from specweave.plans.bootstrap import bootstrap
from specweave.session import Kept
from specweave.sources import buckets
from specweave.streaming import log


def test_rule_based_names(spark, rows):
    names = spark.createDataFrame([("loc_og_t2m_mou_3",), ("arpu",), ("av_of",), ("of",), ("7",)], "column_name string")
    tokens = spark.createDataFrame(
        [("loc", "local"), ("og", "outgoing"), ("of", ""), ("av", "mean")], "token string, text string"
    )
    special = spark.createDataFrame(
        [("arpu", "revenue", "average revenue")], "column_name string, local_name string, description string"
    )
    got = {r.column_name: (r.local_name, r.description) for r in cat.rule_based_names(names, tokens, special).collect()}
    assert got["arpu"] == ("revenue", "average revenue")
    assert got["loc_og_t2m_mou_3"][0] == "local outgoing t2m mou"
    assert got["av_of"] == ("mean", M.RULE_DESCRIPTION % ("mean", "av_of"))
    assert got["of"][0] == "of" and got["7"][0] == "7"


def test_bootstrap_and_checks(spark, rows):
    tables = {"dim": spark.sql("select 'a' id, 1 x"), "fact": spark.sql("select 'a' id, 2D y union all select 'b', 3D")}
    none = spark.createDataFrame([], "token string, text string")
    special = spark.createDataFrame([], "column_name string, local_name string, description string")
    over = spark.createDataFrame([("fact", "y", "INTEGER")], "table_id string, column_name string, declared_type string")
    at = F.lit(datetime.datetime(2024, 1, 1))
    meta = bootstrap(spark, tables, none, special, over, "dim", "id", "demo", at)
    assert rows(meta.table_catalog.select("table_id", "row_count")) == [("dim", 1), ("fact", 2)]
    assert rows(meta.overrides) == [("fact", "y", "DOUBLE", "INTEGER")]
    assert rows(meta.relationships.select("relationship_id", "from_table_id", "to_table_id", "join_key")) == [
        ("rel_dim__fact", "dim", "fact", "id")
    ]
    spec = {r.column_id: r for r in meta.column_spec.collect()}
    assert spec["fact.y"].data_type == "INTEGER" and spec["dim.x"].description.startswith("x | x ")
    assert meta.glossary_drafts.count() == 4
    expected = spark.createDataFrame([("tables", "2"), ("columns", "5")], "check_name string, expected string")
    types = spark.createDataFrame([("fact.y", "INTEGER"), ("gone", "DATE")], "column_id string, data_type string")
    vectors = spark.createDataFrame([], "column_id string")
    lines = cat.quality_checks(meta.table_catalog, meta.column_spec, vectors, meta.relationships, expected, types)
    assert rows(lines.select("check_name", "actual", "passed")) == [
        ("columns", "4", False), ("tables", "2", True), ("type:fact.y", "INTEGER", True), ("type:gone", None, False),
    ]
    assert cat.sample_rows(meta.column_spec, 3).count() == 3


def test_glossary_round(spark, rows):
    catalog = spark.createDataFrame(
        [("t.a", "a", "에이 | first | more"), ("t.b", "b", None), ("t.c", "c", "c | plain")],
        "column_id string, column_name string, description string",
    )
    old = spark.createDataFrame([("term_t.c",)], "term_id string")
    seeds = G.glossary_seed(catalog, old)
    assert rows(seeds.select("term_id", "canonical_term", "synonyms", "source")) == [
        ("term_t.a", "에이", ["a", "에이"], "draft"), ("term_t.b", "b", ["b"], "draft"),
    ]
    replies = spark.createDataFrame(
        [(json.dumps([{"term_id": "term_t.a", "additional_synonyms": ["A", "a"], "domain": "d"},
                      {"term_id": "nobody", "additional_synonyms": ["z"]}]),), ("broken",)],
        "response string",
    )
    merged = G.synonym_merge(seeds, replies)
    assert rows(merged.select("term_id", "suggested_synonyms", "domain")) == [("term_t.a", ["A", "a", "에이"], "d")]
    review = merged.select("term_id", "suggested_synonyms", "domain", F.lit(" Y ").alias("approve"))
    done = G.review_apply(seeds, review)
    assert rows(done.select("term_id", "synonyms", "domain", "source")) == [
        ("term_t.a", ["A", "a", "에이"], "d", M.REVIEWED_SOURCES[0]), ("term_t.b", ["b"], None, "draft"),
    ]
    assert rows(G.review_counts(review)) == [(1, 0)]
    assert rows(G.glossary_texts(done)) == [("term_t.a", "에이 A,a,에이 에이 | first | more")]
    assert rows(G.polish_requests(catalog.where("column_id <> 't.b'"))) == [
        ("t.a", "에이", "first | more"), ("t.c", "c", "plain"),
    ]
    new = spark.createDataFrame([("t.a", "polished")], "column_id string, description string")
    assert rows(G.description_upsert(catalog, new).select("column_id", "description")) == [
        ("t.a", "polished"), ("t.b", None), ("t.c", "c | plain"),
    ]


def test_replies_in_fences_and_unreadable_ones(spark, rows):
    terms = spark.createDataFrame([("t", "term", ["a"], "c")], "term_id string, canonical_term string, synonyms array<string>, linked_column_id string")
    item = '[{"term_id":"t","additional_synonyms":["b"],"domain":"d"}]'
    replies = spark.createDataFrame([(f"```json\n{item}\n```",), ("no list",), ('{"term_id":"t"}',), (None,), ("[]",)], "response string")
    assert rows(G.synonym_merge(terms, replies.limit(1)).select("term_id", "suggested_synonyms")) == [("t", ["a", "b"])]
    assert {r[0] for r in G.unreadable_replies(replies).collect()} == {"no list", '{"term_id":"t"}', None}


def test_review_without_lines_is_settled_by_value(spark, rows):
    terms = spark.createDataFrame([("t", ["a"], "x", "draft")], "term_id string, synonyms array<string>, domain string, source string")
    review = [("t", ["b"], "d1", "y"), ("t", ["c"], "d2", "y"), ("t", ["z"], "d3", "n")]
    for order in (review, review[::-1]):
        df = spark.createDataFrame(order, "term_id string, suggested_synonyms array<string>, domain string, approve string")
        assert rows(G.review_apply(terms, df).select("synonyms", "domain")) == [(["c"], "d2")]


def test_poll_without_news(spark):
    log_rows = spark.createDataFrame([("r1", i, datetime.datetime(2024, 1, 1, 0, 0, i)) for i in range(3)], LOG)
    polls = spark.createDataFrame([("r1", 3), ("r2", 0)], "thread_id string, since long")
    states = spark.createDataFrame([("r1", 1, datetime.datetime(2024, 1, 1), "done")], "thread_id string, event_id long, ts timestamp, status string")
    got = {r.thread_id: (r.next_since, r.status, r.event_id) for r in ev.events_since(ev.event_sequence(log_rows), polls, states).collect()}
    assert got == {"r1": (3, "done", None), "r2": (0, None, None)}


def test_batches_hold_every_row_once(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    for digits in (0, 1, 2):
        packed = G.batch_pack(df, "k", ["k", "v"], 15, digits).collect()
        keys = [r["k"] for b in packed for r in json.loads(b.payload)]
        assert sorted(keys) == sorted(str(i) for i in range(1000))
        sizes = [b.n for b in sorted(packed, key=lambda b: b.batch_no)]
        assert sizes == [15] * 66 + [10]


def test_relations(spark, rows):
    rel = spark.createDataFrame(
        [("a", "b", "k", "1:N"), ("a", "a", "k", "1:1"), ("c", "a", "k", "1:N"), (None, "b", "k", "1:N")],
        "from_table_id string, to_table_id string, join_key string, relation_type string",
    )
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "row_idx long, table_id string")
    got = {r.row_idx: r.table_relationships for r in match.relationship_enrich(df, rel).collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [3, 2, 0, 0]
    counts = {r.row_idx: r.n_relationships for r in match.relationship_counts(df, rel).collect()}
    assert counts == {1: 3, 2: 2, 3: 0, 4: 0}


def sequence(events):
    """Numbering and gaps by a plain loop."""
    out, last = [], {}
    for thread, event, ts in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        n, before = last.get(thread, (0, None))
        out.append((thread, event, n, None if before is None else round((ts - before).total_seconds(), 2)))
        last[thread] = (n + 1, ts)
    return sorted(out, key=str)


def some_events(n):
    start = datetime.datetime(2024, 1, 1)
    # one run holds most of the events, over several hours
    return [("hot" if i % 3 else f"r{i % 7}", i, start + datetime.timedelta(seconds=47 * i)) for i in range(n)]


LOG = "thread_id string, event_id long, ts timestamp"


def test_event_sequence(spark, rows):
    data = some_events(400)
    got = ev.event_sequence(spark.createDataFrame(data, LOG)).select("thread_id", "event_id", "seq", "elapsed_sec")
    assert sorted([tuple(r) for r in got.collect()], key=str) == sequence(data)
    starts = spark.createDataFrame([("hot", datetime.datetime(2023, 12, 31, 23, 59, 0))], "thread_id string, started_at timestamp")
    first = ev.event_sequence(spark.createDataFrame(data, LOG), starts).where("thread_id = 'hot' and seq = 0").first()
    assert first.elapsed_sec == 107.0


def test_a_busy_second_is_cut_into_ranges(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    data = [("hot" if i % 10 else f"r{i % 3}", i * 7919 % 6007, at) for i in range(6000)]
    df = spark.createDataFrame(data, LOG).repartition(9)
    with Kept(spark, f"file://{tmp_path}/kept") as keep:
        placed = numbering.in_ranges(df, ["thread_id", "ts", "event_id"], keep)
        sizes = [r["count"] for r in placed.groupBy(numbering.RANGE).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * 6000 / 4
        got = ev.event_sequence(df, keep=keep).select("thread_id", "event_id", "seq", "elapsed_sec").collect()
    assert sorted([tuple(r) for r in got], key=str) == sequence(data)


def test_numbers_of_no_rows(spark):
    none = spark.createDataFrame([], LOG)
    assert ev.event_sequence(none).count() == 0
    assert G.batch_pack(none, "thread_id", ["thread_id", "event_id"], 3).count() == 0


def test_batches_without_a_digest_are_in_order_of_key(spark):
    df = spark.range(500).select(F.format_string("%04d", 499 - F.col("id")).alias("k")).repartition(5)
    packed = sorted(G.batch_pack(df, "k", ["k"], 7, 0).collect(), key=lambda b: b.batch_no)
    assert [r["k"] for b in packed for r in json.loads(b.payload)] == [f"{i:04d}" for i in range(500)]


def test_log_is_followed_in_batches(spark, tmp_path):
    data = some_events(300)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        spark.createDataFrame(data[part * 100 : part * 100 + 100], LOG).coalesce(1).write.mode("append").parquet(source)
        log.follow_events(log.read_log(spark, source, LOG), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{out}/events").select("thread_id", "event_id", "seq", "elapsed_sec").collect()
    assert sorted([tuple(r) for r in got], key=str) == sequence(data)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    data = some_events(240)
    out = str(tmp_path / "out")
    parts = [spark.createDataFrame(data[k : k + 80], LOG) for k in (0, 80, 160)]
    step = log.event_step(parts[0], out, buckets=5)
    for batch_id in (0, 1, 1, 2, 2):
        step(parts[batch_id], batch_id)
    got = spark.read.parquet(f"{out}/events").select("thread_id", "event_id", "seq", "elapsed_sec").collect()
    assert sorted([tuple(r) for r in got], key=str) == sequence(data)
    counts = Counter(r[0] for r in data)
    assert {r.thread_id: r.n for r in log.run_heads(spark, out, parts[0]).collect()} == counts


def files_of(path):
    return {f for folder, _, names in os.walk(path) for f in (os.path.join(folder, n) for n in names) if f.endswith(".parquet")}


def test_only_touched_buckets_are_read_and_rewritten(spark, tmp_path, rows):
    path, schema = str(tmp_path / "t"), "id long, v string"
    spark.range(1000).select("id", F.lit("old").alias("v")).transform(lambda d: buckets.write_buckets(d, path, ["id"], 16) or d)
    before = files_of(path)
    changes = spark.createDataFrame([(7, "new"), (7000, "more")], schema)

    def merge(stored, new):
        assert "bucket" in stored._jdf.queryExecution().executedPlan().toString()  # pruned by partition
        return stored.join(new, "id", "left_anti").unionByName(new)

    for _ in range(2):  # repeated after a failure
        buckets.upsert_buckets(changes, path, schema, ["id"], merge, 16)
        after = files_of(path)
        touched = {r[0] for r in changes.select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
        same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
        assert same and same <= after and not (before - same) & after
        table = {r.id: r.v for r in buckets.read_buckets(spark, path, schema).collect()}
        assert len(table) == 1001 and {k for k, v in table.items() if v != "old"} == {7, 7000}


def test_audit_is_followed_without_repeats(spark, tmp_path, rows):
    schema = "column_id string, question string, answer string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", "q", "y"), ("a", "q", "y"), ("a", "q", "n")], [("a", "q", "y"), ("b", "q", None)], [("b", "q", None)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        log.follow_audit(log.read_log(spark, source, schema), out, str(tmp_path / "cp")).awaitTermination()
    stored = log.audit_history(spark, out, spark.createDataFrame([], schema))
    assert rows(stored) == [("a", "q", "n"), ("a", "q", "y"), ("b", "q", None)]


def test_node_texts(spark):
    df = spark.createDataFrame(
        [("parsing", "3", None), ("meta_judge", "0.9", "retry"), ("meta_exact_check", "true", None),
         ("meta_exact_check", None, None), ("report", "a%s$1\\b", None), ("other", "x", None), ("meta_no_match", None, None)],
        "node string, detail string, detail2 string",
    )
    out = ev.node_summary(ev.node_metadata(df, ev.node_dictionary(spark))).collect()
    got = {(r.node, r.detail): (r.label, r.summary) for r in out}
    assert got[("parsing", "3")] == (M.NODE_LABELS["parsing"], "3건 파싱 완료")
    assert got[("meta_judge", "0.9")][1] == "확신도 0.9 / 권고 retry"
    assert got[("meta_exact_check", "true")][1] == M.EXACT_CHECK_SUMMARIES["true"]
    assert got[("meta_exact_check", None)][1] == M.EXACT_CHECK_SUMMARIES["false"]
    assert got[("report", "a%s$1\\b")][1] == "명세서 생성 완료: a%s$1\\b"
    assert got[("other", "x")] == ("other", M.DEFAULT_SUMMARY)
    assert got[("meta_no_match", None)][1] == M.NODE_SUMMARIES["meta_no_match"]
