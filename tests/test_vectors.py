"""Vector joins against brute force; the share of pairs that pivots leave out."""

import numpy as np
import pytest

from plumbago.operators import retrieval as R
from plumbago.operators import vectors as V


def clustered(n, dim, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("side,pivots", [(2048, 64), (40, 5)])
def test_pairs_in_range(spark, monkeypatch, side, pivots):
    monkeypatch.setattr(V, "SIDE", side)
    monkeypatch.setattr(V, "GROUP_PIVOTS", pivots)
    x = clustered(600, 8, 1)
    x[5] = 0
    x[9] = x[8]
    g = [["a", "b", None][i % 7 % 3] for i in range(600)]
    df = spark.createDataFrame([(g[i], i, x[i].tolist()) for i in range(600)] + [("a", 600, None)], "g string, id long, v array<double>")
    pairs, count = V.pairs_in_range(df, "g", "id", "v", 0.97)
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if g[i] and g[i] == g[j] and s[i, j] >= 0.97}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    c = count.first()
    assert c.compared < 0.5 * c.possible


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERIES", 7)
    monkeypatch.setattr(V, "ROWS", 90)
    x = clustered(400, 6, 2)
    x[20] = x[21]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "id long, v array<double>")
    got = {(r.q, r.doc, r["rank"]) for r in R.vector_top_k(df.where("id % 20 = 0"), df, 4, "id", "v", exclude_self=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 400, 20):
        order = sorted((d for d in range(400) if d != q), key=lambda d: (-round(float(u[q] @ u[d]), 9), d))
        want |= {(q, d, r + 1) for r, d in enumerate(order[:4])}
    assert got == want
    assert R.vector_top_k(df.limit(0), df, 4, "id", "v").count() == 0


def test_wide_ranges_send_no_copies(spark):
    x = clustered(600, 32, 3)
    df = spark.createDataFrame([("a", i, x[i].tolist()) for i in range(600)], "g string, id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(V.apart(u[:64], np.arccos(0.4))) == 1 and len(V.apart(u[:64], 0.001)) == 64
    pairs, count = V.pairs_in_range(df, "g", "id", "v", 0.4)
    s = u @ u.T
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.4}
    assert count.first().compared <= count.first().possible
