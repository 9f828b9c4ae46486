import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from shelfmark.llm import subword_lm as L
from shelfmark.llm.words import blocks
from tests.llm.plain import LOWER, WORD

SF = "/root/testdata/sf0.01"
RANKED = [b" the", b" t", b"th", b"he", b"e", b"  ", b" a", b"an", b"and", b"\xc3\xa9", b"..", b"in"]


def forward(units, data):
    """Log probability of all segmentations of ``data``, place by place."""
    ahead = [0.0] + [-math.inf] * len(data)
    for j in range(1, len(data) + 1):
        ways = [ahead[j - len(u)] + math.log(p) for u, p in units.items() if len(u) <= j and data[j - len(u) : j] == u]
        top = max(ways)
        ahead[j] = top + math.log(sum(math.exp(w - top) for w in ways))
    return ahead


def counted(units, data):
    """Expected count of each unit over all segmentations of ``data``."""
    ahead = forward(units, data)
    back = list(reversed(forward({u[::-1]: p for u, p in units.items()}, data[::-1])))
    out = Counter()
    for i in range(len(data)):
        for u, p in units.items():
            if data[i : i + len(u)] == u:
                out[u] += math.exp(ahead[i] + math.log(p) + back[i + len(u)] - ahead[-1])
    return out


def test_vocabulary():
    v = L.Vocabulary(RANKED)
    assert len(v.units) == len({*RANKED, *(bytes([b]) for b in range(256))}) and abs(v.shares.sum() - 1) < 1e-12
    share = dict(zip(v.units, v.shares))
    assert share[b" the"] > share[b" t"] > share[b"an"] > share[b"q"]
    real = L.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(real.units) > 31_000 and not real.inside[ord("e") * 256 + ord(" ")]


@pytest.mark.parametrize("together", [48, 3])
def test_marginals_and_counts(monkeypatch, together):
    monkeypatch.setattr(L, "TOGETHER", together)
    v = L.Vocabulary(RANKED)
    units = dict(zip(v.units, v.shares.tolist()))
    texts = [b" the", b"the and", b"\xc3\xa9\x00\xff", b"in an  inn and the hand..", b"a", b"thethethethe and" * 4]
    chunks = L.Chunks(np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts]))
    got = L.marginals(v, v.shares, chunks)
    for value, data in zip(got, texts):
        assert abs(value - forward(units, data)[-1]) < 1e-9
    n = np.array([1, 3, 2, 5, 7, 1])
    found = L.expected(v, v.shares, chunks, n) / L.STEPS
    want = sum((Counter({u: c * k for u, c in counted(units, t).items()}) for t, k in zip(texts, n.tolist())), Counter())
    for u, c in zip(v.units, found):
        assert abs(c - want[u]) < 1e-3
    assert len(L.marginals(v, v.shares, L.Chunks(np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)))) == 0


def test_chunks_lose_no_segmentation():
    """The product over chunks is the sum over all segmentations of the whole text."""
    v = L.Vocabulary(RANKED)
    units = dict(zip(v.units, v.shares.tolist()))
    data = np.frombuffer(b"the hand and  the inn.. \xc3\xa9 tea", dtype=np.uint8)
    starts = L.cut_chunks(v, data, np.array([0, 10, 10, len(data)]))
    assert 10 in starts and len(starts) > 6
    chunks = L.Chunks(data, np.diff(np.append(starts, len(data))))
    each = L.marginals(v, v.shares, chunks)
    for lo, hi in ((0, 10), (10, len(data))):
        own = [x for s, x in zip(starts, each) if lo <= s < hi]
        assert abs(sum(own) - forward(units, data[lo:hi].tobytes())[-1]) < 1e-9


def base(rows):
    """doc_id -> rows of (held out, tokens, known, training tokens, base score)."""
    tokens = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    count = Counter(w for _, held, ws in tokens if not held for w in ws)
    n, v = sum(count.values()), len(count)
    return sorted(((i, held, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for i, held, ws in tokens), key=repr)


def plain_scores(rows, iterations, prior):
    v = L.Vocabulary(RANKED)
    shares, ends = v.shares, 0
    train = [(t or "").encode() for i, t in rows if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    end = 0.5
    for _ in range(iterations):
        units, found = dict(zip(v.units, shares.tolist())), Counter()
        for t in train:
            found += counted(units, t)
        total = np.array([prior * s + found[u] for u, s in zip(v.units, v.shares)])
        shares, ends = total / total.sum(), len(train)
        end = (ends + 1) / (total.sum() + ends + 1)
    units = dict(zip(v.units, (shares * (1 - end)).tolist()))
    return [(forward(units, (t or "").encode())[-1] + math.log(end)) / math.log(10) for _, t in rows]


def made():
    r = random.Random(4)
    words = ["the", "The", "hand", "and", "in", "an", "inn..", "é", "日本", "x\x85y", "q"]
    rows = [(i, r.choice([" ", "\n", "  "]).join(r.choice(words) for _ in range(r.randrange(30)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, " \t\r\n"), (None, "the hand"), (5, rows[5][1]), (73, "q" * 700), (74, "the and " * 300)]


def test_all_documents(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 0.5, 3) for i, t in rows], "doc_id long, text string, score double, block long")
    result = L.score(df.repartition(3), L.Vocabulary(RANKED), iterations=2, block_words=150)
    got = sorted(map(tuple, result.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-8 for g, w in zip(got, want))
    scores = sorted(plain_scores(rows, 2, L.PRIOR))
    assert all(abs(a - b) < 1e-4 for a, b in zip(sorted(g[6] for g in got), scores))
    assert L.score(df.limit(0), L.Vocabulary(RANKED)).collect() == []


def test_without_training_texts(spark):
    df = spark.createDataFrame([(i, "the hand") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = L.score(df, L.Vocabulary(RANKED)).collect()
    assert rows and all((r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0 for r in rows)


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    result = QUERIES["op12_subword_lm"](spark, SF).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in result), key=repr)
    for g, w in zip(got, base(rows), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6
    # Training makes held-out texts likelier than the vocabulary's own shares do.
    v = L.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    held = [(i, t) for i, t in rows if t and zlib.crc32(str(i).encode()) % 7 == 2]
    score = {r["doc_id"]: r["score"] for r in result}
    first = 0.0
    for _, t in held:
        block = next(blocks(pa.array([t])))
        starts = L.cut_chunks(v, block.data, block.bounds)
        first += L.marginals(v, v.shares, L.Chunks(block.data, np.diff(np.append(starts, len(block.data))))).sum() / math.log(10)
    assert sum(score[i] for i, _ in held) > 0.8 * first
