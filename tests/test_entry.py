import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# Quick ones run here; tools/compare.py runs all of them.
SAMPLE = [
    "split_large", "governance_filter", "expand_queries", "content_list_blocks", "next_version", "kb_counts", "dense_search", "find_duplicates",
]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_oracles_are_valid_sql(database):
    for name, sql in entry.oracle_sql().items():
        database.sql(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, database, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = database.sql(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"request_id", "rank", "chunk_id", "score"} <= set(df.columns)
    assert df.count() > 0
