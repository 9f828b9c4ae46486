import hashlib
import re

from pyspark.sql import functions as F

from shelfmark.functions import assets as A
from shelfmark.functions import hashing as H
from shelfmark.functions import progress as P
from shelfmark.functions import text as T


def test_tokens_follow_the_script(one):
    assert one(T.tokenize, " two words\tand\n more ") == ["two", "words", "and", "more"]
    assert one(T.tokenize, "知识 库 a b") == ["知", "识", "库", "a", "b"]
    assert one(T.tokenize, "かな ハン") == ["かな", "ハン"]  # kana alone are words
    assert one(T.tokenize, "  ") == []


def test_join_depends_on_all_tokens(spark):
    rows = spark.createDataFrame([(["知", "识"],), (["知", "word"],)], "t array<string>")
    assert [r[0] for r in rows.select(T.join_tokens(F.col("t"))).collect()] == ["知识", "知 word"]


def test_spread_image_references_are_closed_up(one):
    spread = "before ! [ a pic ] ( /api/v1 /documents/ x ) mid ![b]( other file.png ) after"
    assert one(T.repair_image_refs, spread) == "before ![a pic](/api/v1/documents/x) mid ![b](other file.png) after"
    assert one(T.repair_image_refs, "no image! here (x)") == "no image! here (x)"
    assert one(T.repair_image_refs, "![x](images/ a.png)") == "![x](images/a.png)"


def test_query_rewriting(one):
    assert one(T.rewrite_query, "  what   is\tit ?！") == "what is it "
    assert one(T.rewrite_query, "plain") == "plain"
    assert one(T.rewrite_query, "a.b?") == "a.b"


def test_query_decomposition(one):
    assert one(lambda q: T.decompose_query(q, 2), "alpha and beta, gamma") == ["alpha", "beta"]
    assert one(lambda q: T.decompose_query(q, 3), "sand And land") == ["sand And land"]
    assert one(lambda q: T.decompose_query(q, 5), "一，二；三？") == ["一", "二", "三"]
    assert one(lambda q: T.decompose_query(q, 5), ",one,") == [",one,"]


def test_query_expansion_keeps_first_of_equal(one):
    both = one(lambda q: T.expand_query(q, F.lit(True), F.lit(True), F.lit(True), 3), " a , b , a? ")
    assert both == ["a , b , a", T.HYDE_HEAD + "a , b , a" + T.HYDE_TAIL, "a", "b"]
    assert one(lambda q: T.expand_query(q, F.lit(False), F.lit(False), F.lit(False)), "  ") == []
    only_marks = one(lambda q: T.expand_query(q, F.lit(True), F.lit(False), F.lit(False)), "??")
    assert only_marks == ["??"]  # an empty rewrite falls back to the query


def test_bounded_input(one):
    assert one(lambda c: T.bound_input(c, 5), "abc 　defg") == "abc"
    assert one(lambda c: T.bound_input(c, 50), "abc ") == "abc "


def test_content_sniffing(one):
    kind = lambda t, c: one(T.parsed_content_type, t, c).split(";")[0]
    assert kind("html", "<p>x</p>") == "text/html"
    assert kind("html", "just text") == "text/plain"
    assert kind("txt", "x\n## Head") == "text/markdown"
    assert kind("txt", "|a|\n|--|") == "text/markdown"
    assert kind(".PDF", "x") == "text/markdown"
    assert kind(None, "pre<x") == "text/plain"
    wide = lambda t, c: one(T.content_kind, t, c)
    assert wide("txt", "- item") == "markdown"
    assert wide("txt", "cost $x_1$") == "markdown"
    assert wide("txt", "\\(a\\)") == "markdown"
    assert wide("txt", "<table>") == "html"
    assert wide("txt", "x" * 6000 + "\n# late") == "text"


def test_decode_replaces_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff\xc3\xa9"),)], "b binary")
    assert df.select(T.decode_text(F.col("b"))).first()[0] == "ok �é"


def test_hash_index_is_exact(spark):
    tokens = ["a", "the", "été", "知识", "x" * 200]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    got = [r[0] for r in df.select(H.hash_index(F.col("t"))).collect()]
    assert got == [int(hashlib.sha256(t.encode()).hexdigest(), 16) % 1_000_003 for t in tokens]


def test_sparse_vector_counts_and_merges_collisions(one):
    v = one(lambda c: H.sparse_vector(c, 1), "alpha beta Alpha")
    assert (v["indices"], v["values"]) == ([0], [3.0])
    text = "Été été_1 x-y 知识, 知识 ½"
    v = one(H.sparse_vector, text)
    want = {}
    for token in re.findall(r"\w+", text.lower()):
        i = int(hashlib.sha256(token.encode()).hexdigest(), 16) % 1_000_003
        want[i] = want.get(i, 0.0) + 1
    assert dict(zip(v["indices"], v["values"])) == want and v["indices"] == sorted(want)
    empty = one(H.sparse_vector, "...")
    assert (empty["indices"], empty["values"]) == ([], [])


def test_asset_urls_and_names(one):
    d, a = "0" * 8 + "-0000-0000-0000-" + "1" * 12, "0" * 8 + "-0000-0000-0000-" + "A" * 12
    url = f"/api/v1/documents/{d}/assets/{a}"
    keys = one(A.asset_keys, f"![x]({url}) again {url} /api/v1/documents/short/assets/no")
    assert [(k["document_id"], k["asset_id"]) for k in keys] == [(d, a.lower())]
    name = lambda p, t: one(lambda x, y: A.safe_asset_name(x, y, F.lit(4)), p, t)
    assert name("a\\b\\my pic.png", "image/png") == "my_pic.png"
    assert name("media/raw", "image/jpeg") == "raw.jpg"
    assert name("", "x/unknown") == "asset-5.bin"
    assert one(A.source_stem, "dir/Übung one.v2.md") == "bung_one.v2"
    assert one(A.source_stem, None) == "document"
    assert one(A.is_visual_type, "IMAGE/PNG; q=1") is True
    assert one(A.is_visual_type, "image/svg+xml") is False


def test_progress_rules(spark):
    df = spark.createDataFrame([(3, 10, "pending", None), (20, 10, "Failed", 7), (1, 0, "processing", 30)], "d int, t int, s string, p int")
    rows = df.select(
        P.progress_between(F.lit(46), F.lit(84), F.col("d"), F.col("t")),
        P.stage_percent(F.col("d"), F.col("t")),
        P.document_progress(F.col("s"), F.col("p")),
    ).collect()
    assert [tuple(r) for r in rows] == [(57, 30, 18), (84, 100, 100), (84, 100, 30)]
    kept = spark.range(1).select(
        P.progress_struct("x", 140, "s", "d", started_at=F.lit("2024-01-01").cast("timestamp"), completed=F.lit(-2)).alias("p")
    ).first()["p"]
    assert (kept["progress"], kept["completed"], str(kept["started_at"])[:10]) == (100, 0, "2024-01-01")
