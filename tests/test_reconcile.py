"""One whole run over the given tables: every tag and every way to it, open questions and their answers."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from specweave.operators import judge, validate
from specweave.operators.events import audit_dedupe
from specweave.plans.reconcile import ask_key, reconcile
from specweave.session import shared
from specweave.sources.tables import catalog_snapshot

SF = "/root/testdata/sf0.001"
AT = datetime.datetime(2025, 2, 3, 4, 5)
ROW = "spec_id string, row_idx long"
TABLES = ["part", "events", "lineitem", "orders"]
# catalog types that differ from the real ones, and a column that the table has lost
DECLARED = {"lineitem.l_linenumber": "VARCHAR", "orders.o_custkey": "DOUBLE"}
LOST = ("events.session", "events", "session", "VARCHAR", "visit the event belongs to")
MEANT = {
    "price of the whole order": "orders.o_totalprice",
    "tax of the line": "lineitem.l_tax",
    "brand of the part": "part.p_brand",
}
# (spec, row): name, description, period, expected tag, path and period held
ASKED = {
    # names that the catalog has
    ("lines", 3): ("l_shipmode", "how it ships", None, None),  # no column of that name: see below
    ("lines", 4): ("l_discount", "rebate", " 200109~200202", ("confirm_period", "validated", "200109~200111")),
    ("lines", 5): ("  l_returnflag", "sent back", "199502~199502", ("full_period", "validated", "199502~199502")),
    ("lines", 6): ("l_linenumber", "line of the order", None, ("full_period", "validated", "199501~200111")),
    ("lines", 8): ("l_linenumber", "line of the order", None, ("type_mismatch", "validated", None)),
    ("lines", 9): ("l_linenumber", "line of the order", None, None),
    ("web", 11): ("session", "visit", "202401~202401", ("not_found", "validated", None)),
    ("web", 12): ("event_type", "what was done", "", ("full_period", "validated", "202401~202401")),
    ("web", 13): ("value", "worth", "202312~202401", ("confirm_period", "validated", "202401~202401")),
    ("web", 14): ("value", "worth", "202402~202405", ("period_mismatch", "validated", None)),
    ("web", 15): ("props", "details", "January~202401", None),
    ("web", 16): ("p_type", "kind of part", None, ("period_mismatch", "validated", None)),
    # names that it has not
    ("money", 21): ("o_totalprise", "price of the whole order", "200001~200012", ("full_period", "auto_confirmed", "200001~200012")),
    ("money", 22): ("tax_rate", "tax of the line", None, ("full_period", "validated", "199501~200111")),
    ("money", 23): ("duty", "tax of the line", None, ("unresolved", "rejected_by_human", None)),
    ("money", 24): ("levy", "tax of the line", None, None),
    ("money", 25): ("marque", "brand of the part", None, None),
    ("money", 26): ("??", "weather at sea", None, ("unresolved", "no_match", None)),
    ("money", 27): ("o_totalprice_eur", "price of the whole order", None, ("full_period", "auto_confirmed", "199501~200108")),
}
WITHOUT_VECTOR = ["how it ships"]


def said(column, confidence):
    return json.dumps({"selected_column_id": column, "confidence": confidence, "evidence": f"reads like {column}"})


REPLIES = [
    ("money", 21, 0, said("orders.o_totalprice", 0.72)),  # unsure, so it is asked again with a wider search
    ("money", 21, 1, said("orders.o_totalprice", 0.94)),
    ("money", 22, 0, said("lineitem.l_tax", 0.41)),
    ("money", 23, 0, said("lineitem.l_tax", 0.41)),
    ("money", 24, 0, said("orders.o_comment", 0.97)),  # no candidate of that id
    ("money", 27, 0, said("orders.o_totalprice", 0.93)),
]
ANSWERS = [("money", 23, "rejected"), ("money", 22, "approved")]
TYPE_ANSWERS = [("lines", 8, "rejected"), ("lines", 6, "approved")]


def one_hot(k, more=0.0):
    return [1.0 if i == k else more for i in range(6)]


@pytest.fixture(scope="module")
def world(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in TABLES}
    snapshot = catalog_snapshot(spark, tables)
    known = [(f"{r.table_id}.{r.column_name}", r.table_id, r.column_name, r.data_type) for r in snapshot.collect()]
    columns = [(c, t, n, DECLARED.get(c, kind), f"{n} in {t}", None, None, None) for c, t, n, kind in known]
    catalog = spark.createDataFrame(
        [*columns, (*LOST, None, None, None)],
        "column_id string, table_id string, column_name string, data_type string, description string, "
        "tag string, confidence double, updated_at timestamp",
    )
    fields = "eng_name string, local_name string, description string, req_type string, req_period string"
    rows = spark.createDataFrame([(*k, name, None, text, "DOUBLE", period) for k, (name, text, period, _) in ASKED.items()], f"{ROW}, {fields}")
    held = {c: one_hot(i) for i, c in enumerate(MEANT.values())}
    texts = {d: one_hot(i, 0.02) for i, d in enumerate(MEANT)} | {"weather at sea": one_hot(5)}
    vector = "embedding array<double>"
    months = validate.months({"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"})
    return dict(
        rows=rows, catalog=catalog, snapshot=snapshot, retention=validate.retention_period(tables, months),
        description_vectors=spark.createDataFrame(list(texts.items()), f"description string, {vector}"),
        column_vectors=spark.createDataFrame(list(held.items()), f"column_id string, {vector}"),
        terms=spark.createDataFrame([("levy", "lineitem.l_tax"), ("sea", None)], "term_id string, linked_column_id string"),
        term_vectors=spark.createDataFrame([("levy", one_hot(1, 0.02)), ("sea", one_hot(5))], f"term_id string, {vector}"),
        responses=spark.createDataFrame(REPLIES, f"{ROW}, attempt int, response string"),
        decisions=spark.createDataFrame(ANSWERS, f"{ROW}, decision string"),
        type_decisions=spark.createDataFrame(TYPE_ANSWERS, f"{ROW}, decision string"),
        run_ts=F.lit(AT), dim=6, anchors=2,
    )


@pytest.fixture(scope="module")
def run(world):
    return reconcile(**world, keep=shared)


def keyed(df, *columns):
    return {(r.spec_id, r.row_idx): tuple(r[c] for c in columns) for r in df.collect()}


def test_every_way_to_a_tag(run):
    want = {k: expected for k, (*_, expected) in ASKED.items() if expected}
    assert keyed(run.report, "final_tag", "resolution_path", "avail_period") == want
    assert {tag for tag, _, _ in want.values()} == {
        "unresolved", "not_found", "type_mismatch", "period_mismatch", "full_period", "confirm_period"
    }


def test_what_stays_open(run):
    assert keyed(run.open_types, "column_id") == {("lines", 9): ("lineitem.l_linenumber",)}
    assert set(keyed(run.rejects)) == {("web", 15)}
    assert keyed(run.open_matches, "column_id", "confidence") == {("money", 24): ("lineitem.l_tax", 0.0)}
    asked = {(r.spec_id, r.row_idx, r.attempt): r.payload for r in run.open_judgments.collect()}
    assert set(asked) == {("money", 25, 0)} and '"column_id":"part.p_brand"' in asked["money", 25, 0]
    assert [r.description for r in run.open_vectors.collect()] == WITHOUT_VECTOR
    status = keyed(run.resolved.where("spec_id = 'money' or row_idx = 3"), "match_status")
    assert {k[1]: v[0] for k, v in status.items()} == {
        3: "pending", 21: "auto_confirmed", 22: "inferred_confirmed", 23: "unresolved", 24: "pending", 25: "pending",
        26: "unresolved", 27: "auto_confirmed",
    }


def test_the_best_source_of_a_candidate_counts(run):
    """The term stands as near as the description itself, nearer than the column."""
    found = run.candidates.where("attempt = 0 and column_id = 'lineitem.l_tax'").select("source", "score").distinct().collect()
    assert [tuple(r) for r in found] == [("vss_glossary", 1.0)]


def test_writes_and_audit(run, world):
    tagged = judge.tag_upsert(world["catalog"], run.tag_writes, ["stage", "spec_id", "row_idx"])
    tags = {r.column_id: r.tag for r in tagged.collect() if r.tag}
    assert tags == {
        "lineitem.l_discount": "confirm_period", "lineitem.l_returnflag": "full_period", "lineitem.l_linenumber": "type_mismatch",
        "lineitem.l_tax": "full_period", "events.session": "not_found", "events.event_type": "full_period",
        "events.value": "period_mismatch", "part.p_type": "period_mismatch", "orders.o_totalprice": "full_period",
    }
    confirmed = sorted((r.column_id, r.confidence) for r in run.auto_confirms.collect())
    assert confirmed == [("orders.o_totalprice", 0.93), ("orders.o_totalprice", 0.94)]
    answered = run.confirmations.where("column_id = 'lineitem.l_tax'")
    assert run.confirmations.count() == len(ANSWERS) + len(TYPE_ANSWERS)
    assert audit_dedupe(run.confirmations, answered).count() == len(TYPE_ANSWERS)
    reported = sum(1 for *_, expected in ASKED.values() if expected)
    stats = {(r.kind, r.key): r.n for r in run.summary.collect()}
    assert run.revisions.count() == stats["total", None] == reported
    assert stats["auto_confirm", None] == 2


def test_a_vector_that_arrives_later_opens_the_search(world, spark):
    """A description without vector is no reason to give a row up, and the next run goes on from it."""
    vectors = world["description_vectors"]
    done = reconcile(**{**world, "description_vectors": vectors.where("description <> 'tax of the line'")}, keep=shared)
    assert {r.description for r in done.open_vectors.collect()} == {*WITHOUT_VECTOR, "tax of the line"}
    waiting = {("money", 22), ("money", 23), ("money", 24), ("lines", 3)}
    assert set(keyed(done.resolved.where("match_status = 'pending'"))) == waiting | {("money", 25)}
    assert not waiting & set(keyed(done.report))
    told = spark.createDataFrame([("how it ships", one_hot(4))], "description string, embedding array<double>")
    later = reconcile(**{**world, "description_vectors": vectors.unionByName(told)}, keep=shared)
    assert later.open_vectors.count() == 0
    # its name is like that of the ship date, which the judge is now asked about
    assert {(r.spec_id, r.row_idx) for r in later.open_judgments.collect()} == {("money", 25), ("lines", 3)}


def test_a_function_makes_vectors_in_the_same_run(world, run, spark):
    """It is asked for each text without vector once; what it cannot tell stays open."""
    vectors = world["description_vectors"]
    asked = []

    def embed(texts):
        asked.append([r.description for r in texts.collect()])
        told = vectors.where("description = 'tax of the line'")
        return texts.join(told, "description", "left").withColumn("embedding", F.col("embedding").cast("array<float>"))

    known = vectors.where("description <> 'tax of the line'")
    done = reconcile(**{**world, "description_vectors": known}, keep=shared, embed=embed)
    assert [sorted(texts) for texts in asked] == [sorted([*WITHOUT_VECTOR, "tax of the line"])]
    assert [r.description for r in done.open_vectors.collect()] == WITHOUT_VECTOR
    columns = ("final_tag", "resolution_path", "avail_period")
    assert keyed(done.report, *columns) == keyed(run.report, *columns)


def test_questions_keep_nulls_apart(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), ("x", ""), (" x ", None)], "eng_name string, description string")
    keys = [r[0] for r in rows.select(ask_key(rows)).collect()]
    assert keys[0] == keys[3] and len(set(keys)) == 3
