"""Python workers that are kept give back what a step took."""

import subprocess
import sys

GROWN = """
import re, numpy as np
from pathlib import Path
from shelfmark.functions.memory import handing_back

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) / 1024

kept = []

def run(batches):
    for batch in batches:
        some = [np.ones(12_000) for _ in range(2_000)]  # 190 MB in pieces below the allocator's threshold
        kept.append(np.ones(2_000))  # lies above them, so they stay in the heap when they are freed
        yield batch

def grown(step):
    before = held()
    assert list(step(iter([1, 2]))) == [1, 2]
    return held() - before

print(grown(handing_back(run)), grown(run))
"""


def test_workers_hand_memory_back():
    made = subprocess.run([sys.executable, "-c", GROWN], capture_output=True, text=True, check=True)
    wrapped, plain = map(float, made.stdout.split())
    assert wrapped < 40 < 100 < plain


def test_steps_hand_memory_back(spark, tmp_path, monkeypatch):
    from shelfmark.functions import memory
    from shelfmark.llm import fuzzy_lines, ngram_join

    marks = str(tmp_path / "marks")

    def noted(run):
        def whole(batches):
            yield from run(batches)
            with open(marks, "a") as out:
                out.write(run.__qualname__ + "\n")

        return whole

    for module in (ngram_join, fuzzy_lines):
        assert module.handing_back is memory.handing_back
        monkeypatch.setattr(module, "handing_back", noted)
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.similar(docs).collect()} == {0, 1, 2}
    fuzzy_lines.dedup(docs).collect()
    with open(marks) as made:
        steps = {line.split(".")[0] for line in made}
    assert {"digests", "heads", "_postings", "occurrences", "_met"} <= steps
