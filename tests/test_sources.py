import hashlib

from pyspark.sql import functions as F

from shelfmark.sources import tables as S


def test_uploaded_files(spark, tmp_path):
    (tmp_path / "Report.v2.MD").write_bytes(b"# hi")
    (tmp_path / "README").write_bytes(b"x")
    (tmp_path / "a b+c.txt").write_bytes(b"y")
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = {r["name"]: r for r in S.source_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Report.v2.MD", "README", "a b+c.txt"}  # the empty file is left out
    assert (rows["Report.v2.MD"]["file_type"], rows["Report.v2.MD"]["file_size"]) == ("md", 4)
    assert rows["Report.v2.MD"]["file_hash"] == hashlib.sha256(b"# hi").hexdigest()
    assert rows["README"]["file_type"] == "readme"  # no dot: the name is the type
    assert rows["README"]["reason"] is None


def test_layout_outputs_prefer_the_newer_format(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "doc_content_list.json").write_text("[1, 2, 3]")
    (tmp_path / "a" / "doc_content_list_v2.json").write_text("[2]")
    (tmp_path / "other_content_list.json").write_text("[]")
    (tmp_path / "notes.json").write_text("[]")
    rows = {r["document_name"]: r["layout_json"] for r in S.source_content_list(spark, str(tmp_path)).collect()}
    assert rows == {"doc": "[2]", "other": "[]"}


def test_pages_and_text(spark):
    pages = spark.createDataFrame([("http://x/1", "<p>", ""), ("http://x/2", "<p>", "two")], "url string, html string, name string")
    assert [r["name"] for r in S.source_pages(pages).orderBy("url").collect()] == ["http://x/1", "two"]
    text = spark.createDataFrame([("é", "markdown"), ("b", None)], "content string, file_type string")
    rows = S.source_text(text).orderBy(F.desc("content")).collect()
    assert [(r["file_type"], r["file_size"]) for r in rows] == [("md", 2), ("txt", 1)]


def test_arrow_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    long_texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text"))
    made = [r["n"] for r in long_texts.mapInArrow(sizes, "n long").collect()]
    assert sum(made) >= 400 * 50_000 and max(made) < 8 << 20
