"""Run registered queries against their SQL twins in DuckDB: compare.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
import duckdb  # noqa: E402

from shelfmark.session import local_session  # noqa: E402
from shelfmark.checks import ORACLES, QUERIES, load  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(frame):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple(None if pd.isna(v) else (round(v, 9) if isinstance(v, float) else v) for v in row))
    return sorted(rows, key=repr)


def main():
    sf = sys.argv[1]
    load()
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:26s} {len(got):7d} {took:6.1f}s", flush=True)
                continue
            want = con.sql(ORACLES[name]).df()
            if sorted(got.columns) != sorted(want.columns):
                raise AssertionError(f"columns {sorted(got.columns)} vs {sorted(want.columns)}")
            a, b = normal(got), normal(want)
            if a != b:
                only_a = [r for r in a if r not in set(b)][:2] if len(a) < 50000 else []
                only_b = [r for r in b if r not in set(a)][:2] if len(b) < 50000 else []
                raise AssertionError(f"{len(a)} vs {len(b)} rows; spark {only_a} sql {only_b}")
            print(f"ok    {name:26s} {len(got):7d} {took:6.1f}s  sql {time.time() - start - took:5.1f}s", flush=True)
        except Exception as problem:
            bad.append(name)
            print(f"FAIL  {name:26s} {time.time() - start:6.1f}s {str(problem)[:900]}", flush=True)
    print("failed:", bad)


main()
