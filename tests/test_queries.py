"""Every registered query against DuckDB on the smallest test tables."""

import duckdb
import pandas as pd
import pytest

from changewatch.plans import registry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted((tuple(str(plain(v)) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_outcome_occurs(spark):
    found = {r["outcome"] for r in registry.queries()["document_outcomes"](spark, SF).collect()}
    assert found == {"not_modified", "fetch_failed", "suspect_scrape", "new", "rebaselined", "unchanged", "changed"}
