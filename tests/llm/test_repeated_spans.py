import hashlib
import random

import pytest

from shelfmark.llm import repeated_spans as R
from tests.llm import plain


def run(spark, documents, **more):
    df = spark.createDataFrame([(i, t, 7) for i, t in documents.items()], "doc_id long, text string, start int")
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in R.remove(df, **more).collect()}


def shared_passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 4)))
    passages = [[word() for _ in range(r.randint(8, 30))] for _ in range(5)]
    documents = {}
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts += [word() for _ in range(r.randint(0, 12))]
            passage = list(r.choice(passages))
            if r.random() < 0.4:
                passage[r.randrange(len(passage))] = word()
            parts += passage
        documents[i * 3] = r.choice([" ", "\n", "\t "]).join(parts)
    documents[500] = documents[3]
    documents[501] = documents[3]
    documents[502] = "same " * 400
    documents[503] = "same " * 300
    documents[504], documents[505], documents[506] = None, "", " \n\x0b "
    return documents


@pytest.mark.parametrize("bucket", [4000, 2])
def test_equals_all_windows(spark, bucket):
    documents = shared_passages(bucket)
    assert run(spark, documents, width=8, m=3, bucket=bucket) == plain.kept_words(documents, 8)


def test_full_width(spark):
    r = random.Random(9)
    text = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    fifty, more = text(50), text(60)
    documents = {1: f"{text(30)} {fifty} {text(5)}", 2: f"{fifty} {text(80)}", 3: f"{text(3)}\n{more}", 4: f"{more} {text(2)} {fifty}", 5: text(49), 6: text(70_000)}
    documents[7] = documents[5]
    got = run(spark, documents)
    assert got == plain.kept_words(documents)
    assert (got[2][1], got[4][1], got[7][1]) == (50, 110, 0)


def test_repeated_and_null_keys(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in R.remove(df).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (2, 60)]
    assert R.remove(df.limit(0)).count() == 0


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain.kept_words(documents)
    rows = QUERIES["op3_repeated_spans"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, removed, text = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(text.encode()).hexdigest())
