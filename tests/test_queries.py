"""Every query that has SQL gives the rows that DuckDB gives."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from threadloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    """All queries' rows, several at a time: small jobs leave most cores idle."""
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda f: f(spark, FOLDER).toPandas(), QUERIES[n]) for n in sorted(ORACLE_SQL)}


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else int(v) if not isinstance(v, str) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(results, duck, name):
    got, want = results[name].result(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    numbers = lambda f: f.apply(lambda c: c.astype(float) if c.map(lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool)).all() else c)
    assert plain(numbers(got)) == plain(numbers(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
