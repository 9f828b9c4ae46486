import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return byte_bpe.Encoder(byte_bpe.read_ranks(file.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = st.text(alphabet=st.sampled_from("abcdeinst éñß中文日😀 \n\t\r\x0b\x1c\x85  'sS0159#$|"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(ODD, st.text(max_size=60)))
def test_equals_the_library_and_round_trips(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(np.array(ids, dtype=np.int32)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "=-" * 8000, "日" * 5000, "hello" * 5000, " " * 3000, "x" + " " * 50 + "y"])
def test_long_pieces(encoder, library, text):
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_memos_that_overflow(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUNS", 3)
    monkeypatch.setattr(byte_bpe, "PIECES", 3)
    monkeypatch.setattr(byte_bpe, "PAIRS", 3)
    with open(PATH, "rb") as file:
        small = byte_bpe.Encoder(byte_bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    for text in ["one two three four five six", "one, two. three\n four  five", "a b a b a b a b"]:
        assert small.encode(text) == library.encode_ordinary(text)


def test_tables(spark, library):
    rows = [(1, "Hello  world\n", "x"), (1, "Hello  world\n", "x"), (2, None, "y"), (3, "", "z"), (None, "ü" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "ids", "bytes"]
    got = sorted(((r["doc_id"] or 0, list(r["ids"]), bytes(r["bytes"])) for r in out.collect()), key=repr)
    want = sorted(((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=repr)
    assert got == want
    assert byte_bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, library):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op2_byte_bpe"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(row["text"] or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
        assert got[row["doc_id"]] == want
