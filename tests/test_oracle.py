"""Every query with an SQL twin must equal DuckDB on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.sources.tables import TABLES
from tests.conftest import SF_SMALL

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(s_cols) == sorted(o_cols)
    assert _rows(s_cols, s_rows) == _rows(o_cols, res.fetchall())
    o_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLE[name]}").fetchall()}
    for c, t in df.dtypes:
        assert SPARK_TO_DUCKDB.get(t, t.upper()) == o_types[c], (c, t, o_types[c])
