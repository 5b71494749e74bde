import math

import numpy as np
from linkloom.llm import neighbours


def brute(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok[i] = np.array(v, np.float64)
    out = {}
    for q in ok:
        if q % every == 0:
            s = [(-float(ok[q] @ ok[i] / np.linalg.norm(ok[q]) / np.linalg.norm(ok[i])), i) for i in ok if i != q]
            out[q] = [(i, -x) for x, i in sorted((round(x, 12), i) for x, i in s)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shelf", "2 AS cell", "3 AS vid", "4 AS score")


def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows)
    got = {}
    for r in neighbours.op5_multi_index_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all([n for n, _, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in got.values())


def test_probing_part_of_the_index(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    v = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16)) * 0.3
    rows = [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]
    want = brute([(i, np.float32(x).tolist()) for i, x in rows])
    got = {}
    for x in neighbours.search(frame(spark, rows), share=0.03).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hit = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)


def test_edges_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (50, [0.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0])]
    rows += [(100 + i, [1.0, 0.0, 0.0]) for i in range(20)]
    got = {}
    for r in neighbours.search(frame(spark, rows)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert [got[0][n][0] for n in range(1, 6)] == [1, 2, 9, 100, 101] and got[0][1][1] == 1.0
    assert [got[100][n][0] for n in range(1, 6)] == [0, 1, 2, 9, 101]
    assert got[50][1][0] == 8 and len(got[50]) == 5
    assert set(got) == {0, 50, 100}
    assert neighbours.search(frame(spark, [])).count() == 0
    assert neighbours.search(frame(spark, [(0, [1.0, 2.0])])).count() == 0
    few = neighbours.search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0])])).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_traverse_takes_the_nearest_cells():
    r = np.random.default_rng(1)
    for n, m in ((6, 5), (100, 70), (33, 64)):
        a, b, sizes = r.random(n), r.random(m), r.integers(0, 3, n * m)
        sums = (a[:, None] + b[None, :]).ravel()
        filled = np.flatnonzero(sizes)
        for wanted in (1, 7, int(sizes.sum()) // 10, int(sizes.sum()), 10**9):
            cells, reach = neighbours.traverse(a, b, sizes, wanted)
            order = filled[np.argsort(sums[filled])]
            last = min(int(np.searchsorted(np.cumsum(sizes[order]), wanted)), len(order) - 1)
            assert sorted(cells) == sorted(order[: last + 1]) and reach == sums[order[last]]


def test_recall_without_clusters(spark):
    """12,000 vectors of no structure, more than there are centroids: a tenth of
    them is looked at."""
    v = np.random.default_rng(9).normal(size=(12_000, 48)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    units = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = units[::50] @ units.T
    scores[np.arange(240), np.arange(0, 12_000, 50)] = -2
    want = {q * 50: set(np.argsort(-s)[:5].tolist()) for q, s in enumerate(scores)}
    got = {}
    for x in neighbours.search(df).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hit = sum(len(got[q] & w) for q, w in want.items())
    assert hit >= 0.9 * 5 * len(want), hit
    exact = {}
    for x in neighbours.search(df.where("vec_id < 3000"), every=500, share=1.0).collect():
        exact.setdefault(x.query_id, set()).add(x.vec_id)
    for q, found in exact.items():
        s = units[:3000] @ units[q]
        s[q] = -2
        assert found == set(np.argsort(-s)[:5].tolist())


def test_halves_share_the_variance():
    r = np.random.default_rng(2)
    units = r.normal(size=(2000, 10)) * np.array([9, 8, 7, 6, 5, 1, 1, 1, 1, 1])
    turned = units @ neighbours.rotation(units)
    log = np.log(turned.var(axis=0))
    assert abs(log[:5].sum() - log[5:].sum()) < 4  # unturned: over 15
