"""Every registered query against its oracle SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidegrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda df: sorted(tuple("" if pd.isna(v) else str(pd.Timestamp(v)) if hasattr(v, "year") else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert text(got) == text(want)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    same(catalogue.queries()[name](spark, SF).toPandas(), con.execute(catalogue.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
