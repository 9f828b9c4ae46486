import pytest

from shelfmark.operators import context as O

RESULT = (
    "qid int, rank int, chunk_id string, content string, document_name string, page_num int, authority_level int, review_status string, "
    "governance_source_type string, document_version int, score double, "
    "assets array<struct<id:string,url:string,content_type:string,source_path:string>>"
)


def result(qid, rank, content, assets=(), page=None):
    return (qid, rank, f"c{rank}", content, f"d{rank}", page, 1, "published", "manual", 2, 0.03125, list(assets))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, " why? "), (2, "none")], "qid int, query string")


def test_context_budget(spark, questions):
    pic = ("a1", "/u/1", "image/png", "p.png")
    rows = [result(1, 1, " " + "x" * 500 + " ", [pic], 3), result(1, 2, "y" * 900), result(1, 3, "z")]
    got = {r["qid"]: r["context"] for r in O.source_context(questions, spark.createDataFrame(rows, RESULT), 200).collect()}
    assert got[2] == "No source chunks were retrieved."
    first, second = got[1].split("\n\n")  # the third one has no room
    head = "[S1] document=d1, page 3, authority_level=1, review_status=published, source_type=manual, version=2, chunk_id=c1, score=0.0313"
    lines = "Source assets:\n- asset 1: id=a1, type=image/png, url=/u/1, source_path=p.png"
    assert first == f"{head}\n{lines}\n{'x' * 500}"
    heading2 = second.split("\n")[0]
    room = 1000 - len(first) - len(heading2) - 16
    assert second == f"{heading2}\n{'y' * room}\n...[truncated]"


def test_extractive_answer(spark, questions):
    pic, table = ("a1", "/u/1", "image/png", "p.png"), ("a2", "/u/2", "text/csv", "t.csv")
    rows = [result(1, n, f" text {n} ", [pic, table] if n == 2 else []) for n in range(1, 5)]
    got = {r["qid"]: r["answer"] for r in O.extractive_answer(questions, spark.createDataFrame(rows, RESULT), "Because.").collect()}
    parts = got[1].split("\n\n")
    assert parts[:2] == ["## Answer", "Because."]
    assert "### S3 - d3\n\ntext 3" in got[1] and "### S4" not in got[1]
    assert "- [S4] `d4` - authority 1 - published - chunk `c4` - score `0.0313`" in got[1]
    assert got[1].endswith("## Source Assets\n\n![S2 asset 1](/u/1)\n- [S2 asset 2](/u/2)")
    assert got[2].endswith("## Question\n\nnone") and "no usable sources" in got[2]


def test_assets_already_shown_are_not_repeated(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [([("S1 asset 1", "/u/1", "image/png"), ("S1 asset 2", "/u/2", "image/png"), ("S2 asset 1", "/u/2", "image/png")],)],
        "assets array<struct<label:string,url:string,content_type:string>>",
    )
    out = df.select(O.asset_section(F.lit("see /u/1  "), F.col("assets"))).first()[0]
    assert out == "see /u/1\n\n## Source Assets\n\n![S1 asset 2](/u/2)"
    assert df.select(O.asset_section(F.lit("/u/1 /u/2 "), F.col("assets"))).first()[0] == "/u/1 /u/2 "


def test_image_selection(spark):
    pic = lambda i, t="image/png": (i, f"/u/{i}", t, "p")
    rows = [result(1, 1, "x", [pic("a"), pic("b", "text/csv")]), result(1, 2, "x", [pic("a"), pic("c", "IMAGE/GIF"), pic("d")])]
    picked = O.select_images(spark.createDataFrame(rows, RESULT), 2).orderBy("image_rank").collect()
    assert [(r["asset_id"], r["source_id"]) for r in picked] == [("a", "S1"), ("c", "S2")]


def test_pictured_results_keep_every_chunk(spark, monkeypatch):
    from shelfmark.checks import load, retrieval

    load()
    held = spark.range(60).selectExpr("'c' || id AS chunk_id", "1L AS document_id", "int(id) AS chunk_index", "'t' AS content")
    monkeypatch.setattr(retrieval.X, "chunks", lambda spark, sf: held)
    got = {r["chunk_index"]: len(r["assets"]) for r in retrieval.pictured_results(spark, "").collect()}
    assert sorted(got) == list(range(60)) and got[56] > 0
