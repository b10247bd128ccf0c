"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from allelake import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    value = lambda x: "~" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = [c for c in want.columns if pd.api.types.is_float_dtype(want[c])]
    got[[c for c in numbers if c in got]] = got[[c for c in numbers if c in got]].astype(float)
    assert _rows(got) == _rows(want)


def test_whole_tables(spark, duck):
    """Queries over all variants leave none out."""
    distinct = lambda name: QUERIES[name](spark, SF).select("key").distinct().count()
    called = duck.execute("SELECT count(DISTINCT l_orderkey) FROM lineitem").fetchone()[0]
    assert distinct("tiering") == distinct("x09_search_document") == called
    pending = duck.execute("SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 0").fetchone()[0]
    assert distinct("x06_pending") == pending


def test_all_members_and_chromosomes(spark, duck):
    calls, variants = duck.execute("SELECT count(DISTINCT (l_orderkey, l_suppkey % 20)), (SELECT count(*) FROM orders) FROM lineitem").fetchone()
    gaps = QUERIES["j21_fill_gaps"](spark, SF)
    assert gaps.count() == gaps.select("key", "sample").distinct().count() == 20 * variants - calls
    assert {len(r.line.split("\t")) for r in QUERIES["k02_vcf_lines"](spark, SF).collect()} == {9 + 20}
    assert {len(r.line.split(" ")) for r in QUERIES["k03_tped"](spark, SF).collect()} == {4 + 40}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
