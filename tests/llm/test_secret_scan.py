import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import secret_scan as S


def plain_base(text):
    """The base patterns as the contract states them."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PIECES = st.sampled_from(["token", "Password", "API_KEY", "apikey", "ſecret", "toKen", " ", "=", ":", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "abcdef", "secret", "é", "\n", "xYz9+/Q", "-", "z"])


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(PIECES, max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted(S.base_spans(text)) == plain_base(text)
    spans = S.all_spans(text)
    assert sorted(x for x in spans if x[0] in ("assign", "access", "hex")) == plain_base(text)


@settings(max_examples=200, deadline=None)
@given(value=st.text(alphabet="abcdef0123456789ABCXYZ", min_size=8, max_size=60), bits=st.floats(1.0, 3.0))
def test_windows_equal_direct_counts(value, bits):
    width, covered = 8, set()
    for i in range(len(value) - width + 1):
        counts = Counter(value[i : i + width]).values()
        if -sum(c / width * math.log2(c / width) for c in counts) >= bits - 1e-12:
            covered.update(range(i, i + width))
    got = set()
    for a, b in S.dense_windows(value, width, bits):
        got.update(range(a, b))
    assert got == covered


def test_added_spans_and_allow_list():
    key = "q7Zp2Lk9Xv4Rt8Wn3Bm6"
    assert S.all_spans(f"id {key} end") == [("entropy_base64", 3, 23)]
    assert S.all_spans("id 123e4567-e89b-12d3-a456-426614174000") == []
    assert S.all_spans("see the-quick-brown-fox-jumps-over") == []
    assert S.all_spans(f"key EXAMPLE{key}") == []
    inside = S.all_spans(f"token={key}")
    assert [x[0] for x in inside] == ["assign"]


def test_a_placeholder_word_hides_its_own_part_only():
    key = "q7Zp2Lk9Xv4Rt8Wn3Bm6Yc5Hd1Gf0Js"
    for text in (f"example-bucket/{key}", f"DUMMY_OLD/{key}", f"{key}/placeholder"):
        assert key not in S.redacted(text, S.all_spans(text))
    assert S.all_spans(f"key EXAMPLE{key}") == []
    assert S.all_spans("example/Zz" + "q" * 30) == []


def test_table(spark):
    rows = [(1, "token = abcdef123", 5), (1, "token = abcdef123", 5), (2, None, 6), (3, "", 7), (4, "x" * 300_000 + " AKIA" + "A" * 20, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r["doc_id"], [tuple(x) for x in r["spans"]]) for r in S.scan(df).collect())
    assert got == [(1, [("assign", 0, 17)])] * 2 + [(2, []), (3, []), (4, [("access", 300_001, 300_025)])]
    clean = {r["doc_id"]: r["text"] for r in S.redact(df).collect()}
    assert clean[1] == "[SECRET]" and clean[2] is None and clean[3] == "" and clean[4] == "x" * 300_000 + " [SECRET]"
    assert S.scan(df.limit(0)).count() == 0


def test_query(spark):
    import hashlib

    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op5_secret_scan"](spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base = sorted(plain_base(row["text"] or ""), key=lambda s: (s[1], S.KINDS.index(s[0])))
        r = got[row["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x[0] for x in base) for k in ("assign", "access", "hex"))
