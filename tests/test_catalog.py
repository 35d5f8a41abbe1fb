"""Every registered query over the tables against its DuckDB form."""

import math
import os

import pytest

from wirelake.plans import catalog, frames

QUERIES, SQL = catalog.queries() | frames.queries(), catalog.oracle_sql() | frames.oracle_sql()

FOLDER = os.environ.get("TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def values(frame):
    columns = sorted(frame.columns)

    def text(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(round(v, 8)) if isinstance(v, float) else str(v)

    return columns, sorted(tuple(map(text, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got)
        return
    assert values(got) == values(duck.execute(SQL[name]).df())
