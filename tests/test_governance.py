import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import filters as B
from shelfmark.operators import governance as G
from shelfmark.sources import sinks as S

DOCUMENT = (
    "document_id long, kb_id long, name string, file_type string, file_size long, minio_path string, file_hash string, "
    "source_type string, source_url string, governance_source_type string, authority_level int, review_status string, "
    "current_version int, status string, chunk_count int, error_message string, content string"
)


def document(i, **over):
    row = dict(
        document_id=i, kb_id=1, name=f"n{i}", file_type="txt", file_size=3, minio_path="p", file_hash=f"h{i}",
        source_type="upload", source_url=None, governance_source_type="manual", authority_level=2, review_status="draft",
        current_version=1, status="completed", chunk_count=4, error_message=None, content="abc",
    )
    return tuple({**row, **over}.values())


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), DOCUMENT)


def test_name_match_wins_over_hash(spark):
    existing = documents(spark, document(1, name="a", file_hash="x"), document(2, name="b", file_hash="y"), document(3, kb_id=2, name="c"))
    incoming = documents(
        spark,
        document(11, name="a", file_hash="y"),
        document(12, name="z", file_hash="y"),
        document(13, name="c", file_hash="q"),
        document(14, name="d", file_hash=None),
    )
    got = {r["document_id"]: (r["duplicate_of"], r["reason"]) for r in G.find_duplicates(incoming, existing).collect()}
    assert got == {11: (1, "duplicate_name"), 12: (2, "duplicate_file_hash"), 13: (None, None), 14: (None, None)}


def dedup_reference(rows):
    names, hashes, out = set(), set(), {}
    for kb, position, name, file_hash in sorted(rows, key=lambda r: (r[0], r[1])):
        if name is not None and (kb, name) in names:
            out[(kb, position)] = "duplicate_name"
        elif file_hash is not None and (kb, file_hash) in hashes:
            out[(kb, position)] = "duplicate_file_hash"
        else:
            out[(kb, position)] = None
            names.add((kb, name))
            hashes.add((kb, file_hash))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_dedup_equals_one_by_one(spark, seed):
    """Refused rows block nobody, so chains of dependencies matter."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2]), i, f"n{rng.randrange(25)}", rng.choice([None, *[f"h{j}" for j in range(25)]])) for i in range(120)]
    # one name holds a third of all rows
    rows += [(1, 200 + i, "hot", f"u{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "kb_id int, position int, name string, file_hash string")
    got = {(r["kb_id"], r["position"]): r["reason"] for r in G.batch_dedup(df).collect()}
    assert got == dedup_reference(rows)


def chain(n):
    """Each row shares its name with one neighbour and its hash with the other."""
    return [(1, i, f"n{i // 2}", f"h{(i + 1) // 2}") for i in range(n)]


@pytest.mark.parametrize("segment", [7, 40])
def test_batch_dedup_in_segments(spark, segment):
    rng = random.Random(segment)
    rows = [(rng.choice([1, 1, 2]), i, rng.choice([None, *[f"n{j}" for j in range(40)]]), rng.choice([None, *[f"h{j}" for j in range(40)]])) for i in range(150)]
    rows += [(kb, 1000 + p, name, digest) for kb, p, name, digest in chain(60)]
    df = spark.createDataFrame(rows, "kb_id int, position int, name string, file_hash string")
    got = {(r["kb_id"], r["position"]): r["reason"] for r in G.batch_dedup(df, segment=segment).collect()}
    assert got == dedup_reference(rows)


def test_a_long_chain_takes_few_jobs(spark):
    rows = chain(10_000)
    df = spark.createDataFrame(rows, "kb_id int, position int, name string, file_hash string")
    spark.sparkContext.setJobGroup("long-chain", "long chain")
    try:
        got = {(r["kb_id"], r["position"]): r["reason"] for r in G.batch_dedup(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long-chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dedup_reference(rows)
    assert jobs < 40


def test_registration_outcome(spark):
    existing = documents(spark, document(1, name="a", file_hash="x"))
    columns = [c for c in DOCUMENT.replace(",", "").split()[::2] if c not in ("status", "current_version", "chunk_count", "error_message")]
    incoming = documents(
        spark,
        document(10, name="a"),
        document(11, name="b", file_hash="k"),
        document(12, name="c", file_hash="k"),
        document(13, name="d", file_size=0),
        document(14, name="c", file_hash="m"),
    ).select(*columns, F.col("document_id").alias("position"))
    done = G.register_documents(incoming, existing)
    outcome = {r["document_id"]: (r["status"], r["reason"]) for r in done.outcome.collect()}
    assert outcome == {
        10: ("skipped", "duplicate_name"), 11: ("created", None), 12: ("skipped", "duplicate_file_hash"),
        13: ("skipped", "empty_file"), 14: ("created", None),
    }
    created = {r["document_id"]: r for r in done.documents.collect()}
    assert created[11]["status"] == "pending" and created[11]["ingestion_progress"]["progress"] == 10
    assert {(r["document_id"], r["version_number"]) for r in done.versions.collect()} == {(11, 1), (14, 1)}
    audit = done.audit.collect()
    assert {a["action"] for a in audit} == {"document.created"} and all(a["before"] is None for a in audit)


def versions(spark, *pairs):
    docs = documents(spark, *[document(i) for i in sorted({d for d, _ in pairs})])
    numbers = spark.createDataFrame(list(pairs), "document_id long, version_number int")
    return G.version_rows(docs.join(numbers, "document_id"), F.col("version_number"), "v")


def test_governance_update_writes_version_and_audit(spark):
    docs = documents(spark, document(1), document(2), document(3))
    changes = spark.createDataFrame(
        [(1, None, 1, None, "raise"), (2, None, None, None, "nothing")],
        "document_id long, governance_source_type string, authority_level int, review_status string, change_summary string",
    )
    done = G.update_governance(docs, changes, versions(spark, (1, 1), (1, 2), (2, 1)))
    rows = {r["document_id"]: (r["authority_level"], r["current_version"], r["review_status"]) for r in done.documents.collect()}
    assert rows == {1: (1, 3, "draft"), 2: (2, 1, "draft"), 3: (2, 1, "draft")}
    (version,) = done.versions.collect()
    assert (version["document_id"], version["version_number"], version["change_summary"]) == (1, 3, "raise")
    (audit,) = done.audit.collect()
    assert (audit["before"]["authority_level"], audit["after"]["authority_level"], audit["after"]["current_version"]) == (2, 1, 3)


def test_content_update_and_reprocess(spark):
    docs = documents(spark, document(1, error_message="old", source_url="u"), document(2))
    chunks = spark.createDataFrame([(1, "c1"), (2, "c2")], "document_id long, chunk_id string")
    assets = spark.createDataFrame([(1, "a1")], "document_id long, asset_id string")
    changes = spark.createDataFrame([(1, "nëw", "markdown", None)], "document_id long, content string, file_type string, change_summary string")
    done = G.update_content(docs, changes, versions(spark, (1, 1)), chunks, assets)
    new = {r["document_id"]: r for r in done.documents.collect()}[1]
    assert (new["source_type"], new["file_type"], new["file_size"], new["status"], new["chunk_count"]) == ("text", "md", 4, "pending", 0)
    assert new["source_url"] is None and new["minio_path"] is None and new["current_version"] == 2
    assert [r["chunk_id"] for r in done.chunks.collect()] == ["c2"] and done.assets.count() == 0
    assert done.audit.first()["summary"] == "Source content updated"

    snapshots = docs.select("document_id", F.lit("parsed").alias("content"))
    again = G.reprocess(docs, docs.where("document_id = 1"), chunks, assets, snapshots)
    assert {r["document_id"] for r in again.snapshots.collect()} == {r["document_id"] for r in docs.collect()} - {1}
    row = {r["document_id"]: r for r in again.documents.collect()}[1]
    assert (row["status"], row["error_message"], row["current_version"]) == ("pending", None, 1)
    assert again.versions.count() == 0
    audit = again.audit.first()
    assert audit["before"] is None and audit["action"] == "document.reprocessed"


def test_cascading_deletion(spark):
    docs = documents(spark, document(1), document(2, kb_id=2))
    audit = G.audit_events(docs, "document.created", "s", None, G.snapshot())
    chunks = spark.createDataFrame([(1, "c1"), (2, "c2")], "document_id long, chunk_id string")
    out = G.delete_documents({"documents": docs, "chunks": chunks, "audit": audit}, docs.where("document_id = 1"))
    assert [r["document_id"] for r in out["documents"].collect()] == [2]
    assert [r["chunk_id"] for r in out["chunks"].collect()] == ["c2"]
    kept = sorted((r["action"], r["document_id"] or 0) for r in out["audit"].collect())
    assert kept == [("document.created", 0), ("document.created", 2), ("document.deleted", 0)]
    kbs = spark.createDataFrame([(1,), (2,)], "kb_id long")
    gone = G.delete_kbs({"documents": docs, "chunks": chunks, "audit": audit}, kbs, kbs.where("kb_id = 2"))
    assert [r["kb_id"] for r in gone["knowledge_bases"].collect()] == [1]
    assert [r["document_id"] for r in gone["documents"].collect()] == [1]
    assert sorted(r["action"] for r in gone["audit"].collect()) == ["document.created"] * 2


@pytest.mark.parametrize("step", [1, 3])
def test_next_versions_with_a_hot_document(spark, step):
    changes = [(7, i * step) for i in range(200)] + [(8, 5), (9, 6), (9, 1)]
    df = spark.createDataFrame(changes, "document_id long, change_seq int")
    got = {(r["document_id"], r["change_seq"]): r["version_number"] for r in G.next_version(df, versions(spark, (7, 1), (7, 4))).collect()}
    assert all(got[(7, i * step)] == 5 + i for i in range(200))
    assert (got[(8, 5)], got[(9, 1)], got[(9, 6)]) == (1, 1, 2)


def test_outcomes_and_upserts(spark):
    docs = documents(spark, document(1, error_message="old"), document(2), document(3))
    outcomes = spark.createDataFrame([(1, None, 9), (2, "e" * 3000, None)], "document_id long, error string, chunk_count int")
    rows = {r["document_id"]: r for r in G.mark_outcomes(docs, outcomes).collect()}
    assert (rows[1]["status"], rows[1]["error_message"], rows[1]["chunk_count"], rows[1]["progress"]) == ("completed", None, 9, 100)
    assert (rows[2]["status"], len(rows[2]["error_message"]), rows[2]["chunk_count"]) == ("failed", 2000, 4)
    assert rows[3]["progress"] is None

    old = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1)], "chunk_id string, v int, seq int")
    assert sorted((r[0], r[1]) for r in S.upsert_points(old, new, "chunk_id", "seq").select("chunk_id", "v").collect()) == [("a", 1), ("b", 6), ("c", 7)]


def test_governance_filter_rules(spark):
    docs = documents(
        spark,
        document(1, review_status="published", authority_level=1),
        document(2, review_status="draft", authority_level=3),
        document(3, review_status="published", authority_level=5, governance_source_type="law"),
    )

    def ids(filters):
        return sorted(r["document_id"] for r in B.governance_filter(docs, filters).collect())

    assert ids({}) == [1, 3]
    assert ids({"include_unpublished": True}) == [1, 2, 3]
    assert ids({"include_unpublished": True, "review_status": "draft"}) == [1, 2, 3]
    assert ids({"include_unpublished": "yes", "review_status": 5}) == [1, 3]
    assert ids({"review_status": "draft"}) == [2]
    assert ids({"max_authority_level": 4}) == [1]
    assert ids({"governance_source_type": "law", "authority_level": 5}) == [3]
    assert ids({"authority_level": "5"}) == [1, 3]


def test_assets_export_and_metadata_switch(spark):
    rows = [(1, 1, "image/png", 3, bytearray(b"abc")), (1, 2, "text/csv", 900, bytearray(b"x" * 900))]
    df = spark.createDataFrame(rows, "document_id int, asset_id int, content_type string, file_size int, content binary")
    out = {r["asset_id"]: r for r in B.export_assets(df, 100).collect()}
    assert out[1]["data_uri"] == "data:image/png;base64,YWJj" and out[1]["reason"] is None
    assert out[2]["data"] is None and "larger than max_bytes=100" in out[2]["reason"]
    assert "\n" not in B.export_assets(df, 5000).where("asset_id = 2").first()["data"]
    tagged = spark.createDataFrame([({"a": "b"},)], "metadata map<string,string>")
    assert B.include_metadata(tagged, False).first()["metadata"] == {}
    assert B.include_metadata(tagged, True).first()["metadata"] == {"a": "b"}


def test_asset_replacement(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id int, asset_id string")
    new = spark.createDataFrame([(1, "c")], "document_id int, asset_id string")
    assert sorted(r["asset_id"] for r in S.replace_rows(old, new).collect()) == ["b", "c"]
    emptied = S.replace_rows(old, new.limit(0), spark.createDataFrame([(2,)], "document_id int"))
    assert [r["asset_id"] for r in emptied.collect()] == ["a"]
