"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

from conftest import SF
from specweave.queries import REGISTRY
from specweave.queries.inputs import SCHEMAS, TABLES
from tools.check import rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    got = q(spark, SF).toArrow()
    if q.oracle is None:
        assert got.num_rows > 0
        return
    want = con.execute(q.oracle).to_arrow_table()
    assert rows_of(got) == rows_of(want)


def test_schemas_are_those_of_the_tables(con):
    for t in TABLES:
        kinds = [f"{r[0]} {r[1]}" for r in con.execute(f"describe {t}").fetchall()]
        assert ", ".join(kinds) == SCHEMAS[t]
