"""Every query of the package: with oracle compared, all run on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from specweave.llm.queries import ORACLES, QUERIES
from specweave.queries.inputs import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert got.num_rows > 0
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert rows_of(got) == rows_of(con.execute(ORACLES[name]).to_arrow_table())


PLAIN = """
import sys
sys.path.insert(0, {root!r})
from specweave.session import local_session
import corpus_pipeline
from specweave.llm.queries import QUERIES
spark = local_session(4, partitions=4)
for name in {names!r}:
    print(name, QUERIES[name](spark, {folder!r}).count())
print("stage", corpus_pipeline.drop_toxic(spark, spark.read.parquet({folder!r} + "/documents.parquet"), {folder!r}).count())
"""


def test_on_executors_without_the_package(tmp_path):
    """The driver finds the package by its own path; its workers do not."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op4_log_bilinear", "op9_convolution", "op11_wrapper", "op12_hirschberg", "op13_count_min"]
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != root]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    code = PLAIN.format(root=root, names=names, folder=SF)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == [*names, "stage"]
