"""Every query with oracle SQL gives the rows that DuckDB gives, on the sf0.01 tables."""

import glob
import math
import os

import duckdb
import pytest

from sigloom import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), sorted(cols)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got, gc = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(catalog.oracle_sql()[name])
    want, wc = rows(rel.columns, rel.fetchall())
    assert gc == wc
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
