import random
import re
from collections import Counter

import duckdb

from shelfmark.llm import phrases as P
from tests.llm.plain import LOWER

SF = "/root/testdata/sf0.01"


def expected(rows, least, top=None, percent=80):
    """All result rows from counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= percent * f[lang, w[i : i + m]]:
                    dropped.add((lang, w[i : i + m]))
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            s, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, -s, -a, " ".join(w).encode(), l, r))
    place, result = Counter(), []
    for lang, s, a, phrase, l, r in sorted(out):
        place[lang] += 1
        if top is None or place[lang] <= top:
            result.append((lang, place[lang], phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(result)


def found(df, **options):
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


def made(seed, n=120):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "river", "stone", "é", "ß日", "x\x85y", "-", "tea", "cup"]
    rows = [(r.choice(["en", "de", "und", None]), r.choice([" ", "\t", "  "]).join(r.choice(words) + r.choice(["", "", "", "", ".", ",", "\n", "\x0b", "?! "]) for _ in range(r.randrange(60)))) for _ in range(n)]
    rows += [("en", "a cup of tea and a cup of tea")] * 9 + [("en", None), (None, None), ("de", ""), ("en", " .\n. ; "), ("fr", "one")]
    return rows + [("en", "long lines of words " * 3000)]


def test_all_phrases(spark):
    rows = made(3)
    df = spark.createDataFrame([(*r, 7, 0.5) for r in rows], "lang string, text string, n long, score double")
    want = expected(rows, 5)
    assert len(want) > 50
    assert found(df.repartition(3), least=5, top=None, block_words=400) == want
    assert found(df, least=5, top=6) == expected(rows, 5, 6)


def test_equal_scores_rank_by_bytes(spark):
    rows = [("en", f"{x} {y}") for x, y in [("b", "é"), ("b", "z"), ("ä", "c"), ("zz", "d")] for _ in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, least=4) == expected(rows, 4)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert found(df, least=2) == [] and found(df.limit(0)) == []


def test_counts_beyond_64_bits(spark):
    """2000000 * a passes 64 bits; so do the products of the containment rule."""
    a, s = 2**62, 2**62 + 1
    row = spark.sql(f"SELECT cast(2000000 as decimal(10, 0)) * {P.wide(str(a))} div ({P.wide(str(a))} + {P.wide(str(s))}) AS q, 100 * {P.wide(str(a))} >= 80 * {P.wide(str(s))} AS t").first()
    assert (row["q"], row["t"]) == (2000000 * a // (a + s), True)


def test_query(spark):
    from shelfmark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op11_phrases"](spark, SF).collect())
    assert got == sorted(con.sql(ORACLES["op11_phrases"]).fetchall())
    texts = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == expected(texts, 30, 2000)
