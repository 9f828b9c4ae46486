"""What the operators keep on disk while they run."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from shelfmark.llm import fuzzy_lines, ngram_join
from shelfmark.llm.scratch import CLEANUP, folder, written


def test_shuffle_files_go_with_the_write(spark):
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    set_to, before = spark.conf.get(CLEANUP), files()
    out = written(spark.range(10_000).repartition("id"), "numbers")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEANUP) == set_to and out.count() == 10_000


def test_lines_travel_in_shares(spark, monkeypatch):
    sent, met = [], fuzzy_lines._met

    def counted(words, *rest):
        sent.append(words.count())
        return met(words, *rest)

    monkeypatch.setattr(fuzzy_lines, "_met", counted)
    rows = [(i, i + 20, 7 * i, 0, 0, 0, [i * 31 + k for k in range(5)], i) for i in range(200)]
    nodes = spark.createDataFrame(rows, "h long, n int, q0 long, q1 long, q2 long, q3 long, rare array<long>, component long")
    fuzzy_lines._near(nodes, True, 80, 4096).count()
    assert sum(sent) == 1000 and max(sent) <= 500


def test_a_row_meets_few_leaders(spark):
    """Row 99 shares each of 50 columns with another row that leads it, one of them two columns."""
    led = [(k, 10, 1000 + k, False, 0) for k in range(50)] + [(7, 10, 2000, False, 0)]
    mine = [(99, 10, g, False, 1) for g in [*range(1000, 1050), 2000]]
    postings = spark.createDataFrame(led + mine, "key long, n long, gram long, hot boolean, pos long")
    pairs = [(r["a"], r["b"]) for r in ngram_join._leader_pairs(postings, 80).where(F.col("b") == 99).collect()]
    assert sorted(pairs) == [(0, 99), (7, 99)]


def test_tables_of_line_dedup_go_once_used(spark):
    kept = lambda: {p.name for p in Path(folder(spark).removeprefix("file:")).iterdir() if p.name.startswith(("nodes-", "pairs-", "sequences-"))}
    before = kept()
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five seven"), (3, "other words")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in fuzzy_lines.dedup(df).collect()) == [(1, 0), (2, 1), (3, 0)]
    assert kept() == before


def test_wide_rows_of_line_dedup_go_before_lines_travel(spark, monkeypatch):
    seen, near = [], fuzzy_lines._near

    def watched(*rest):
        seen.append({p.name for p in Path(folder(spark).removeprefix("file:")).iterdir() if p.name.startswith("lines-")})
        return near(*rest)

    before = {p.name for p in Path(folder(spark).removeprefix("file:")).iterdir()}
    monkeypatch.setattr(fuzzy_lines, "_near", watched)
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five seven")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in fuzzy_lines.dedup(df).collect()) == [(1, 0), (2, 1)]
    assert len(seen) == 2 and not set.union(*seen) - before
