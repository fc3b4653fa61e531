"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def tidy(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert [d[0] for d in want.description] == cols
    rows = tidy(got.select(*cols).collect())
    assert rows == tidy(want.fetchall())
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
