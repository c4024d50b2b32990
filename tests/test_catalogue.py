"""Every query of the catalogue against its SQL in DuckDB on the smallest tables; those without SQL must run."""

import glob
import math
import os

import duckdb
import pytest

from lineloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(rows):
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    sql = catalogue.oracle_sql().get(name)
    rows = df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()
    if sql is None:
        return
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(found.columns, map(str, found.types), strict=True))
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    assert _plain(rows) == _plain(con.sql(f"SELECT {columns} FROM ({sql})").fetchall())
