"""Queries that SQL can express, against their SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sketchloom.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    plain = lambda df: sorted(tuple("null" if pd.isna(x) else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(con.sql(catalog.ORACLE_SQL[name]).df())
