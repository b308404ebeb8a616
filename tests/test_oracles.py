"""Every panel query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from panelwright.plans import queries as q

TABLES = ["lineitem"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canonical(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float) + 0.0
    return df.sort_values(cols).reset_index(drop=True).astype(str)


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    got = canonical(q.QUERIES[name](spark, sf_dir).toPandas())
    want = canonical(duck.execute(q.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want), (got[(got != want).any(axis=1)].head(), want[(got != want).any(axis=1)].head())


def test_entry_has_panel_queries(spark):
    import __spark_entry__

    assert set(q.QUERIES) <= set(__spark_entry__.queries())
    assert os.path.isdir("/root/testdata/sf0.001") is False or __spark_entry__.entry(spark).count() > 0
