import numpy as np

from shelfmark.llm import neighbours as N


def exact(keys, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[list(keys).index(q)]
        order = [i for i in np.lexsort((keys, -scores)) if keys[i] != q][:k]
        out[q] = [(int(keys[i]), float(scores[i])) for i in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(spark, keys, vectors):
    return spark.createDataFrame([(int(k), v.tolist(), 3) for k, v in zip(keys, vectors)], "vec_id long, embedding array<double>, rank int")


def test_recall_over_parts(spark):
    r = np.random.default_rng(2)
    vectors = r.standard_normal((3000, 32))
    keys = r.permutation(20_000)[:3000]
    df = frame(spark, keys, vectors)
    asked = sorted(int(k) for k in keys if k % 20 == 0)
    want = exact(keys, vectors, asked, 20)
    for part in (50_000, 700):
        rows = N.search(df, df.where("vec_id % 20 = 0"), 20, part=part).collect()
        got = found(rows)
        assert set(got) == set(asked) and all(len(x) == 20 for x in got.values())
        hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in asked)
        assert hits >= 0.9 * 20 * len(asked)
        for q, pairs in got.items():
            scores = dict(zip(keys.tolist(), vectors @ vectors[list(keys).index(q)]))
            assert all(abs(s - scores[v]) < 1e-9 for v, s in pairs)
            assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


def test_recall_on_uneven_lengths():
    """At the production share, in a part of 20,000: unit vectors, and lengths that differ by an order of magnitude."""
    r = np.random.default_rng(0)
    unit = r.standard_normal((20_000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for vectors in (unit, unit * r.lognormal(0, 0.5, 20_000)[:, None], unit * r.uniform(0.1, 3, 20_000)[:, None]):
        top = np.linalg.norm(vectors, axis=1).max()
        pivots = N.raised(vectors[r.choice(20_000, N.PIVOTS, replace=False)], top)
        part = N.Part([[i] for i in range(20_000)], vectors, pivots, N.LENGTH, N.raised(vectors, top))
        hits, asked = 0, r.choice(20_000, 60, replace=False)
        for q in asked:
            order = N.orders(np.append(vectors[q], 0.0)[None], pivots, N.LENGTH)[0]
            got = {i for _, i in part.nearest(int(q), vectors[q], order, 20, N.SHARE)}
            scores = vectors @ vectors[q]
            scores[q] = -np.inf
            hits += len(got & set(np.argsort(-scores)[:20].tolist()))
        assert hits >= 0.97 * 20 * len(asked)


def test_odd_vectors_ties_and_copies(spark):
    good = [(i, [1.0, float(i % 3)]) for i in range(60)] + [(100 + i, [2.0, 2.0]) for i in range(50)]
    odd = [(200, None), (201, [0.0, 0.0]), (202, [float("nan"), 1.0]), (203, [None, 1.0]), (204, [float("inf"), 1.0]), (None, [1.0, 1.0]), (220, [0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = found(N.search(df, df.where("vec_id % 20 = 0"), 20).collect())
    want = exact(np.array([k for k, _ in good]), np.array([v for _, v in good]), [k for k, _ in good if k % 20 == 0], 20)
    assert got == want
    few = df.where("vec_id < 5")
    assert {len(x) for x in found(N.search(few, few, 20).collect()).values()} == {4}
    assert N.search(df.limit(0), df, 20).count() == 0
    assert N.search(df, df.limit(0), 20).count() == 0


def test_footrule_equals_direct_sum():
    r = np.random.default_rng(4)
    vectors, pivots = r.standard_normal((50, 8)), r.standard_normal((20, 8))
    part = N.Part([[i] for i in range(50)], vectors, pivots, 6)
    order = N.orders(vectors, pivots, 6)
    place = np.full((50, 20), 6)
    for i, row in enumerate(order):
        place[i, row] = np.arange(6)
    query = order[7]
    direct = np.abs(place - place[7]).sum(axis=1)
    assert (6 * 7 - 2 * part.footrule(query) == direct).all()


def test_query(spark):
    from shelfmark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    keys, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = exact(keys, vectors, [int(k) for k in keys if k % 20 == 0], 20)
    got = found(QUERIES["op9_neighbours"](spark, sf).collect())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
