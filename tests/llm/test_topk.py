import math
import random

import numpy as np

from eigenloom.llm.topk import NO_ID, NO_SCORE, BallTree, top_k


def brute(rows, k=5, step=50):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        ok[i] = min(ok.get(i, q), q)
    out = []
    for i, q in ok.items():
        if i % step == 0:
            ranked = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in ok.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(5, [9.0] * 6), (50, None), (100, [None] * 6), (150, [float("nan")] * 6), (7, [float("inf")] * 6), (None, [1.0] * 6), (-50, [0.1] * 6), (2000, [3.0]), (2050, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    for shard_rows in (40, 10_000):
        assert as_rows(top_k(docs, "vec_id", "embedding", shard_rows=shard_rows, block_rows=4)) == want


def test_few_rows_and_large_components(spark):
    rows = [(0, [1e5, -1e5]), (50, [3e5, 2e5]), (3, [1e5, 1e5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert as_rows(top_k(docs, "vec_id", "embedding")) == brute(rows)
    assert top_k(docs.limit(0), "vec_id", "embedding").count() == 0
    assert top_k(docs.where("vec_id = 0"), "vec_id", "embedding").count() == 0


def empty(n, k=5):
    return np.full((n, k), NO_SCORE), np.full((n, k), NO_ID)


def test_a_floor_cuts_leaves():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 300, (40, 4))
    vectors = np.floor(centers[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 4))).astype(np.int64)
    tree = BallTree(**BallTree.build(np.arange(4000), vectors, leaf=50))
    q, own = vectors[:20], np.arange(20)
    best, who, visits = tree.search(q, own, *empty(20))
    floor = best.copy()
    floor[:, :] = best[:, 4:]
    again, _, fewer = tree.search(q, own, floor - 1, np.full((20, 5), NO_ID))
    assert (best == again).all() and visits.mean() < 10 and (fewer <= visits).all()
    assert (np.sort(np.where(np.arange(4000) == own[:, None], -(2**62), q @ vectors.T), axis=1)[:, :-6:-1] == best).all()
    assert ((q[:, None, :] * vectors[who]).sum(axis=2) == best).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for vectors in (rng.integers(-400, 400, (500, 8)), rng.integers(900, 1000, (500, 3)), np.zeros((40, 3), np.int64), np.array([[5, 0], [-5, 0], [0, 0]] * 30)):
        tree = BallTree(**BallTree.build(np.arange(len(vectors)), vectors, leaf=10))
        q = rng.integers(-300, 300, (30, vectors.shape[1])).astype(float)
        q[0] = 0
        norm = np.sqrt((q**2).sum(axis=1))
        for x in range(len(tree.child)):
            a, b = tree.span[x]
            most = (q @ tree.vectors[a:b].astype(float).T).max(axis=1)
            assert (tree.bound(q, norm, np.full(30, x)) >= most).all()


def test_waves_clashing_columns_and_repeats(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], i, "s", -1) for i in range(300)] * 2
    docs = spark.createDataFrame(rows, "id long, v array<float>, shard long, state string, part int")
    want = brute([r[:2] for r in rows])
    for waves in (1, 2, 4):
        assert as_rows(top_k(docs, "id", "v", shard_rows=16, block_rows=3, waves=waves)) == want
