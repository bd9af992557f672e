"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sketchloom.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, tables, name):
    found = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(found) == rows(tables.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
