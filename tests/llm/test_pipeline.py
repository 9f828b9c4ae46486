import corpus_pipeline as C
from shelfmark.llm import secret_scan
from tests.llm import plain
from tests.llm.test_fuzzy_lines import expected

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = C.quality(spark, docs, SF)
    assert good.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = texts(good)
    clean = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.5 * sum(not q for q in labels.values())

    lines = C.line_dedup(spark, docs, SF)
    want = {i: t for i, (n, removed, t) in expected(texts(docs))[0].items() if not (removed and not t.strip())}
    assert lines.columns == columns and texts(lines) == want

    single = C.near_copies(spark, docs, SF)
    groups = plain.near_copies(texts(docs))
    assert single.columns == columns and set(texts(single)) == {i for i, (_, c) in groups.items() if c == i}

    safe = C.secrets(spark, docs, SF)
    assert safe.columns == columns
    assert texts(safe) == {i: secret_scan.redacted(t, secret_scan.all_spans(t)) for i, t in texts(docs).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())

    packed = C.pack(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(texts(docs))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    out = C.run(spark, SF)
    assert out.count() > 50
