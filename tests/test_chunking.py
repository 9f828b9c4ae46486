import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import tokenize
from shelfmark.operators import chunking as C

BLOCKS = (
    "document_id long, block_index int, content string, chunk_type string, page_num int, bbox string, heading_level int, attrs string"
)


def reference_merge(blocks, size, overlap):
    """Independent statement of the merge: simulate the buffer by token positions."""
    size = max(size, 1)
    overlap = max(0, min(overlap, size - 1))
    stream, out = [], []
    begin = None  # start of the open buffer in the stream of small-block tokens
    opener = None

    def close():
        nonlocal begin
        if begin is not None and begin < len(stream):
            words = stream[begin:]
            out.append((("" if all(len(w) == 1 for w in words) else " ").join(words), "text", opener))
        begin = None

    for b in blocks:
        if not b["content"].strip():
            continue
        if b["chunk_type"] != "text":
            close()
            out.append((b["content"], b["chunk_type"], b["block_index"]))
            continue
        text = b["content"]
        cjk = any("㐀" <= ch <= "鿿" for ch in text)
        words = [ch for ch in text if not ch.isspace()] if cjk else text.split()
        if b["heading_level"] > 0 or len(words) > size:
            close()
        if len(words) > size:
            at = 0
            while True:
                piece = words[at : at + size]
                out.append((("" if all(len(w) == 1 for w in piece) else " ").join(piece), "text", b["block_index"]))
                if at + size >= len(words):
                    break
                at += size - overlap
            continue
        if begin is None:
            begin, opener = len(stream), b["block_index"]
        elif len(stream) - begin + len(words) > size:
            kept = min(overlap, len(stream) - begin)
            close()
            begin, opener = len(stream) - kept, b["block_index"]
        stream.extend(words)
    close()
    return out


def random_document(rng, n):
    blocks = []
    for i in range(n):
        words = rng.choice([0, 1, 2, 3, 5, 8, 13, 30])
        alphabet = rng.choice([["a", "bb", "ccc"], ["知", "识 "]])
        blocks.append(
            {
                "block_index": i,
                "content": (" " if alphabet[0] == "a" else "").join(rng.choice(alphabet) for _ in range(words)),
                "chunk_type": rng.choice(["text"] * 8 + ["code"]),
                "heading_level": rng.choice([0] * 9 + [2]),
            }
        )
    return blocks


@pytest.mark.parametrize("segment_rows", [4096, 7])
def test_merge_equals_plain_statement(spark, segment_rows):
    """Also with one document holding most rows, cut into many segments."""
    rng = random.Random(5)
    docs = {d: random_document(rng, n) for d, n in enumerate([400, 5, 1, 30, 0, 7, 8, 14])}
    rows = [
        (d, b["block_index"], b["content"], b["chunk_type"], b["block_index"] + 1, None, b["heading_level"], None)
        for d, blocks in docs.items()
        for b in blocks
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, BLOCKS)
    for size, overlap in [(12, 4), (10, 0), (9, 50)]:
        made = C.merge_blocks(df, size, overlap, segment_rows).collect()
        for d, blocks in docs.items():
            got = sorted((r for r in made if r["document_id"] == d), key=lambda r: r["chunk_index"])
            assert [r["chunk_index"] for r in got] == list(range(len(got)))
            assert [(r["content"], r["chunk_type"], r["opener"]) for r in got] == reference_merge(blocks, size, overlap)
            assert all(r["page_num"] == r["opener"] + 1 for r in got)


def test_array_merge_equals_table_merge(spark):
    rng = random.Random(9)
    blocks = [b | {"page_num": None, "bbox": None, "attrs": None} for b in random_document(rng, 60)]
    schema = "block_index int, content string, chunk_type string, page_num int, bbox string, heading_level int, attrs string"
    df = spark.createDataFrame([(blocks,)], f"b array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    merged = df.select(C.merge_block_arrays(F.col("b"), F.lit(12), F.lit(4)).alias("c")).first()["c"]
    assert [(c["content"], c["chunk_type"], c["opener"]) for c in merged] == reference_merge(blocks, 12, 4)


def test_windows_over_one_block(spark):
    df = spark.createDataFrame([(1, "aa b c d ee f gg"), (2, "xx y"), (3, " ")], "id long, t string")
    rows = C.split_large(df.select("id", tokenize(F.col("t")).alias("k")), "k", 3, 1).collect()
    assert [(r["id"], r["chunk_index"], r["content"]) for r in rows] == [
        (1, 0, "aa b c"), (1, 1, "c d ee"), (1, 2, "ee f gg"), (2, 0, "xx y"),
    ]
    clamped = C.split_large(df.select("id", tokenize(F.col("t")).alias("k")).where("id = 1"), "k", 3, 9).count()
    assert clamped == 5  # an overlap of size - 1 steps by one token


def sheet_reference(lines):
    groups, current = [], []
    for n, line in lines:
        used = sum(len(x) + 1 for _, x in current)
        if current and (len(current) >= 100 or used + len(line) > 500):
            groups.append(current)
            current = []
        current.append((n, line))
    return groups + ([current] if current else [])


@pytest.mark.parametrize("segment_rows", [4096, 130, 6])
def test_sheet_chunks_equal_plain_statement(spark, segment_rows):
    rng = random.Random(segment_rows)
    sheets = {
        "long": [(i * 2 + 1, "R: " + "x" * rng.choice([0, 1, 3, 40, 120, 600])) for i in range(700)],
        "tiny": [(i + 1, "ab") for i in range(250)],
        "one": [(9, "y" * 900)],
    }
    rows = [(s, i, n, line) for s, lines in sheets.items() for i, (n, line) in enumerate(lines)]
    df = spark.createDataFrame(rows, "sheet string, position long, row_number long, line string")
    made = C.sheet_chunks(df, ["sheet"], "sheet", "position", segment_rows).collect()
    for s, lines in sheets.items():
        got = sorted((r for r in made if r["sheet"] == s), key=lambda r: r["chunk_part"])
        want = sheet_reference(lines)
        assert [r["content"] for r in got] == ["\n".join([f"Sheet: {s}", *[x for _, x in g]]) for g in want]
        assert [(r["row_start"], r["row_end"], r["row_count"]) for r in got] == [(g[0][0], g[-1][0], len(g)) for g in want]
        assert [r["chunk_part"] for r in got] == list(range(1, len(want) + 1))


def test_sheet_rows_drop_trailing_and_empty(spark):
    df = spark.createDataFrame([("s", 1, ["a", "", "b", None, ""]), ("s", 2, ["", None])], "sheet string, n long, v array<string>")
    rows = C.sheet_rows(df, ["sheet"], F.col("v"), "n").collect()
    assert [r["line"] for r in rows] == ["R1: a |  | b"]


def overlap_reference(left, right):
    for n in range(min(len(left), len(right), 8000), 11, -1):
        if left[-8000:].endswith(right[:n]) and len("".join(right[:n].split())) >= 12:
            return n
    return 0


def test_shared_edge_against_search(spark):
    rng = random.Random(3)
    for _ in range(300):
        left = "".join(rng.choice("ab ") for _ in range(rng.randrange(60)))
        right = left[rng.randrange(len(left) + 1) :] + "".join(rng.choice("ab ") for _ in range(20))
        assert C.shared_edge(left, right) == overlap_reference(left, right)


@pytest.mark.parametrize("segment_rows", [4096, 3])
def test_documents_are_rebuilt_from_chunks(spark, segment_rows):
    words = [f"word{i}" for i in range(400)]
    chunks = [(1, i, " ".join(words[i * 20 : i * 20 + 28])) for i in range(20)]
    chunks += [(2, 0, " first part "), (2, 1, ""), (2, 2, "second part"), (3, 0, "alone")]
    df = spark.createDataFrame(chunks, "document_id long, chunk_index int, content string")
    made = C.merge_overlaps(df, segment_rows)
    texts: dict = {}
    for r in sorted(C.rebuild_documents(made, segment_rows).collect(), key=lambda r: (r["document_id"], r["part"])):
        texts[r["document_id"]] = texts.get(r["document_id"], "") + r["content"]
    assert texts == {1: " ".join(words[:400]), 2: "first part\n\nsecond part", 3: "alone"}
    stats = {r["document_id"]: tuple(r)[1:] for r in C.overlap_stats(made).collect()}
    assert stats[1][1] == 19 and stats[2] == (0, 0)


def test_mixed_ingest_takes_all_kinds(spark, monkeypatch):
    import json
    from collections import defaultdict

    from shelfmark.checks import QUERIES, corpus, load

    load()
    seen, whole = [], corpus.ingest

    def ingest(docs, kbs):
        seen.append(docs)
        return whole(docs, kbs)

    monkeypatch.setattr(corpus, "ingest", ingest)
    sf = "/root/testdata/sf0.001"
    found = QUERIES["ingest_mixed"](spark, sf)
    docs = {r["document_id"]: r for r in seen[0].collect()}
    assert {r["document_id"] for r in found.collect()} == {i for i in docs if i % 8 == 1}
    assert {i % 8 for i in docs} == set(range(8))
    done = whole(seen[0], corpus.X.knowledge_bases(spark, sf))
    chunks = defaultdict(dict)
    for r in done.chunks.select("document_id", "chunk_index", "content").collect():
        assert r["chunk_index"] not in chunks[r["document_id"]]
        chunks[r["document_id"]][r["chunk_index"]] = r["content"]
    outcomes = done.outcomes.collect()
    assert sorted(r["document_id"] for r in outcomes) == sorted(docs)
    for r in outcomes:
        made = chunks.get(r["document_id"], {})
        assert sorted(made) == list(range(r["chunk_count"]))
        assert (r["chunk_count"] > 0) == (r["status"] == "completed")
    for i, d in docs.items():
        if i % 8 == 3 and chunks.get(i):
            want = {w for b in json.loads(d["content"]) for w in b["text"].split()}
            assert {w for c in chunks[i].values() for w in c.split()} == want


DOCS = "document_id string, kb_id long, name string, file_type string, tags array<string>, content string"


def test_texts_are_tokenised_once(spark):
    from pyspark.sql import functions as F

    from shelfmark.functions.text import WS
    from shelfmark.plans.ingest import build_chunks

    kbs = spark.createDataFrame([(1, 8, 2)], "kb_id long, chunk_size int, chunk_overlap int")
    docs = spark.createDataFrame([("a", 1, "a", "txt", [], "ww " * 50)], DOCS)
    chunks = build_chunks(docs, kbs)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    # One split into words, and one window expression over what it made.
    assert plan.count(f"{WS}+, -1)") == 1
    assert [r["content"] for r in chunks.orderBy("chunk_index").collect()] == [" ".join(["ww"] * n) for n in [8] * 8]


def test_delivered_assets_and_uuid_documents(spark):
    """Files beside a layout list, in a document whose id is a UUID: URLs hold that id, and chunks and assets meet."""
    import json

    from shelfmark.plans.ingest import ingest

    uuid = "123E4567-e89b-12d3-a456-426614174000"
    kbs = spark.createDataFrame([(1, 128, 16)], "kb_id long, chunk_size int, chunk_overlap int")
    layout = [{"type": "text", "text": "One."}, {"type": "image", "img_path": "images/p.png", "image_caption": ["cap"]}]
    docs = spark.createDataFrame([(uuid, 1, "a.pdf", "pdf", [], json.dumps(layout)), ("7", 1, "b.md", "md", [], "see [x](images/p.png) here"), ("8", 1, "c.exe", "exe", [], "x")], DOCS)
    files = spark.createDataFrame([(d, 1, 0, "image", "images/p.png", "image/png", None, bytearray(b"px")) for d in (uuid, "7", "8")], "document_id string, kb_id long, asset_index int, asset_type string, source_path string, content_type string, aliases array<string>, content binary")
    done = ingest(docs, kbs, assets=files, once=True)
    assets = {r["document_id"]: r for r in done.assets.collect()}
    chunks = {(r["document_id"], r["chunk_index"]): r for r in done.chunks.collect()}
    assert set(assets) == {uuid, "7"} and assets[uuid]["url"].startswith(f"/api/v1/documents/{uuid.lower()}/assets/")
    assert chunks[uuid, 1]["content"] == f"cap\n![cap]({assets[uuid]['url']})" and assets[uuid]["chunk_id"] == chunks[uuid, 1]["chunk_id"]
    assert chunks["7", 0]["content"] == f"see [x]({assets['7']['url']}) here" and assets["7"]["chunk_id"] == chunks["7", 0]["chunk_id"]
    assert {r["document_id"]: (r["status"], r["chunk_count"]) for r in done.outcomes.collect()} == {uuid: ("completed", 2), "7": ("completed", 1), "8": ("failed", 0)}
    assert "images/" not in {r["document_id"]: r for r in done.snapshot.collect()}["7"]["content"]
