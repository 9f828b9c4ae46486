import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import parsing as M
from shelfmark.operators.references import rewrite_asset_refs


def parse(spark, job, text):
    df = spark.createDataFrame([(1, text)], "document_id long, content string")
    return sorted(job(df).collect(), key=lambda r: r["block_index"])


def test_markdown_blocks(spark):
    text = (
        "# Top\n\nintro line\nnext\n\n## Part\n\n![cap](img/a.png \"t\")\n\n|a|b|\n|---|---|\n|1|2|\n\n"
        "```py\nx = 1\n\ny\n```\n\n- one\n- two\n\npara\n```\ncode in para\n```\n~~~\nopen\n```\nstill\n"
    )
    rows = parse(spark, M.markdown_blocks, text)
    assert [(r["block_type"], r["chunk_type"], r["heading_level"]) for r in rows] == [
        ("heading", "text", 1), ("paragraph", "text", 0), ("heading", "text", 2), ("image", "image", 0),
        ("table", "table", 0), ("code", "code", 0), ("list", "text", 0), ("paragraph", "text", 0), ("code", "code", 0),
    ]
    assert [list(r["title_path"]) for r in rows][:4] == [[], ["Top"], ["Top"], ["Top", "Part"]]
    assert rows[3]["attrs"] == {"image_path": "img/a.png", "image_caption": "cap", "image_refs": "img/a.png"}
    assert rows[7]["content"] == "para\n```\ncode in para\n```"
    assert rows[8]["content"] == "~~~\nopen\n```\nstill"


def test_heading_line_with_image_stays_a_heading(spark):
    rows = parse(spark, M.markdown_blocks, "# ![x](y.png)\n\n##\n\ntext\n\n# a\nb")
    assert [(r["block_type"], r["chunk_type"], r["heading_level"]) for r in rows] == [
        ("image", "text", 1), ("paragraph", "text", 0), ("paragraph", "text", 0), ("heading", "text", 0),
    ]
    assert list(rows[2]["title_path"]) == ["![x](y.png)"]


def test_html_blocks(spark):
    html = (
        "<html><head><style>p{}</style><script>var a='<p>no</p>'</script></head><body>outside"
        "<h1>Big <b>title</b>.</h1><p>one &amp; two<br>three</p><img src=' pic.png ' alt='A  pic'>"
        "<p>before<li>inner</li>lost</p><table class=\"t\"><tr><td>x < y<table><td>n</td></table></td></tr></table>"
        "<h3>Deep</h3><pre>  a\n b</pre><img alt='none'></body>"
    )
    rows = parse(spark, M.html_blocks, html)
    assert [(r["block_type"], r["content"]) for r in rows] == [
        ("h1", "Big title ."),
        ("p", "one & two three"),
        ("image", '<figure><img src="pic.png" alt="A pic"><figcaption>A pic</figcaption></figure>'),
        ("p", "before"),
        ("li", "inner"),
        ("table", '<table class="t"><tr><td>x &lt; y<table><td>n</td></table></td></tr></table>'),
        ("h3", "Deep"),
        ("pre", "a b"),
    ]
    assert [list(r["title_path"]) for r in rows][-2:] == [["Big title ."], ["Big title .", "Deep"]]
    assert rows[2]["chunk_type"] == "image" and rows[2]["attrs"]["image_path"] == "pic.png"


def test_rendered_html(spark):
    df = spark.createDataFrame([("<h2>A & b</h2><p>c</p>",)], "h string")
    out = df.select(M.rendered_html(M.html_block_array(F.col("h")))).first()[0]
    assert out == "<h2>A &amp; b</h2>\n<p>c</p>"


def test_layout_blocks(spark):
    layout = [
        {"type": "text", "text": "Title", "level": 1, "page_idx": 0, "bbox": [1, 2, 3, 4]},
        {"type": "Text", "text": "## Sub", "page_idx": 0},
        {"type": "table", "table_caption": ["T1", " "], "html": "<table/>", "footnote": "note", "page_idx": 1},
        {"type": "image", "img_caption": ["a]b"], "img_path": "images\\p.png", "position": {"x": 1}},
        {"type": "chart", "image_caption": [], "caption": "c"},
        {"type": "equation", "latex": "x^2"},
        {"type": "list", "list_items": ["one", ["two", 3]]},
        {"type": "code", "code_caption": "cap", "code_body": "x=1"},
        {"type": "text", "text": ""},
        "not a block",
        {"text": "plain", "level": "2"},
    ]
    df = spark.createDataFrame([(1, json.dumps(layout)), (2, '{"a": 1}'), (3, "broken")], "document_id long, layout_json string")
    rows = sorted(M.content_list_blocks(df).collect(), key=lambda r: r["block_index"])
    assert [r["content"] for r in rows] == [
        "Title", "## Sub", "T1\n<table/>\nnote", "a]b\n![a\\]b](images\\p.png)", "c", "$$\nx^2\n$$", "one\ntwo\n3", "cap\nx=1", "plain",
    ]
    assert [r["chunk_type"] for r in rows] == ["text", "text", "table", "image", "image", "equation", "text", "text", "text"]
    assert [r["heading_level"] for r in rows] == [1, 2, 0, 0, 0, 0, 0, 0, 0]
    assert list(rows[0]["title_path"]) == ["Title"] and list(rows[1]["title_path"]) == ["Title", "Sub"]
    assert rows[0]["bbox"] == '{"points":[1,2,3,4]}' and rows[3]["bbox"] == '{"x":1}'
    assert rows[3]["attrs"]["image_path"] == "images/p.png" and rows[0]["page_num"] == 1
    assert rows[0]["content_blocks"] == 10 and rows[0]["page_count"] == 2
    assert [r[0] for r in df.select(M.is_layout_list(F.col("layout_json"))).collect()] == [True, False, False]


def test_data_images(spark):
    good = base64.b64encode(b"pixels").decode()
    text = f"a ![one](data:image/png;base64,{good}) ![bad](data:image/png;base64,@@) ![two](data:image/JPEG;base64,{good})"
    df = spark.createDataFrame([(1, 1, "my doc.md", text)], "document_id long, kb_id long, name string, content string")
    out = M.extract_data_images(df)
    assert out.first()["content"] == "a ![one](assets/my_doc-1.png) ![bad](data:image/png;base64,@@) ![two](assets/my_doc-2.jpg)"
    assets = sorted(M.asset_rows(out).collect(), key=lambda r: r["asset_index"])
    assert [(a["content_type"], a["file_size"], a["aliases"][1]) for a in assets] == [
        ("image/png", 6, "./assets/my_doc-1.png"), ("image/jpeg", 6, "./assets/my_doc-2.jpg"),
    ]
    page = f"<p><IMG alt='x' src='data:image/gif;base64,{good}'></p>"
    df = spark.createDataFrame([(1, 1, None, page)], "document_id long, kb_id long, name string, content string")
    assert M.extract_data_images(df, html=True).first()["content"] == "<p><IMG alt='x' src='assets/document-1.gif'></p>"


def test_references_are_rewritten(spark):
    text = '![a]( images/a(1).png ) [b](./b.png) [c](http://x/b.png) <img src="B.png"> <a HREF=\'images/a(1).png\'> ![d](missing.png)'
    blocks = spark.createDataFrame([(1, 0, text), (2, 0, "[b](./b.png)")], "document_id long, block_index int, content string")
    aliases = spark.createDataFrame(
        [(1, "images/a(1).png", "/U1", 0), (1, "./b.png", "/U2", 1), (1, "b.png", "/U3", 1), (1, "http://x/b.png", "/NO", 2)],
        "document_id long, alias string, url string, asset_index int",
    )
    out = {r["document_id"]: r["content"] for r in rewrite_asset_refs(blocks, aliases).collect()}
    assert out[1] == "![a](/U1) [b](/U2) [c](http://x/b.png) <img src=\"/U3\"> <a HREF='/U1'> ![d](missing.png)"
    assert out[2] == "[b](./b.png)"


def test_prefixes_do_not_mix_aliases(spark):
    """Aliases with closing marks, one a start of another, in links and attributes; other documents' aliases stay out."""
    text = "![a](p(1).png) ![b](p(1) .png) [c](p(1) <a href=\"it's.png\"> <a href='it's.png'> [d](other.png)"
    blocks = spark.createDataFrame([(1, 0, text), (1, 1, None), (2, 0, text)], "document_id long, block_index int, content string")
    aliases = spark.createDataFrame([(1, "p(1).png", "/A", 0), (1, "p(1", "/B", 1), (1, "it's.png", "/C", 2), (3, "other.png", "/D", 3)], "document_id long, alias string, url string, asset_index int")
    out = {(r["document_id"], r["block_index"]): r["content"] for r in rewrite_asset_refs(blocks, aliases).collect()}
    assert out[1, 0] == "![a](/A) ![b](/B) .png) [c](/B) <a href=\"/C\"> <a href='/C'> [d](other.png)"
    assert out[1, 1] is None and out[2, 0] == text
    assert rewrite_asset_refs(blocks, aliases.limit(0)).where("document_id = 1 and block_index = 0").first()["content"] == text


def path_reference(blocks, inclusive):
    path, out = [], []
    for level, text in blocks:
        before = path
        if level > 0 and text.strip("# ").strip():
            path = path[: level - 1] + [text]
        out.append(path if inclusive else (before if level > 0 else path))
    return out


@pytest.mark.parametrize("segment_rows", [4096, 5])
@pytest.mark.parametrize("inclusive", [True, False])
def test_title_paths_equal_a_stack(spark, segment_rows, inclusive):
    rng = random.Random(2)
    docs = {d: [(rng.choice([0, 0, 1, 2, 3, 6]), f"t{i}") for i in range(n)] for d, n in [(1, 90), (2, 4), (3, 1)]}
    rows = [(d, i, level, text) for d, blocks in docs.items() for i, (level, text) in enumerate(blocks)]
    df = spark.createDataFrame(rows, "document_id long, block_index int, heading_level int, content string")
    got = M.title_path(df, inclusive, segment_rows=segment_rows).collect()
    for d, blocks in docs.items():
        mine = [list(r["title_path"]) for r in sorted((r for r in got if r["document_id"] == d), key=lambda r: r["block_index"])]
        assert mine == path_reference(blocks, inclusive)


def test_routing(spark):
    df = spark.createDataFrame([(".MD",), (None,), ("exe",), ("xlsx",), ("png",), ("htm",)], "file_type string")
    rows = M.route_by_type(df).collect()
    assert [r["route"] for r in rows] == ["markdown", "text", None, "layout", "image", "html"]
    assert rows[2]["error"] == "Unsupported document type: exe"
