from __future__ import annotations

import numpy as np

from evigraph.llm import neighbours


def brute(rows, every, k):
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)
            out[i] = d[:k]
    return out


def data(n, d=24):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, d)) * 2
    x = (centre[rng.integers(0, 6, n)] + rng.standard_normal((n, d))).astype(np.float32).astype(float)
    x[50:90] = x[50]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_recall_and_scores(spark):
    rows = data(1500)
    bad = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [1.0] * 3), (2400, [None] * 24), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, rank int").repartition(6)
    got: dict = {}
    for r in neighbours.neighbours(df, every=20, list_rows=100, part_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    exact = {i: dict((j, d) for d, j in brute(rows, 20, len(rows))[i]) for i in list(want)[:5]}
    assert all(abs(exact[i][j] - d) < 1e-12 for i in exact for d, j in got[i])
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (10 * len(want)) >= 0.9
    assert [j for _, j in got[60]] == [50, 51, 52, 53, 54, 55, 56, 57, 58, 59]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.neighbours(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 1)]
    assert neighbours.neighbours(df.where("vec_id > 5")).count() == 0
