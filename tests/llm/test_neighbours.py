import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import neighbours as N

ROWS = "vec_id long, embedding array<float>"


def slow(rows, asked, k):
    """Nearest by the plain formula in double, over usable vectors."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            ok[i] = min(ok.get(i, v), v)
    out = {}
    for q in ok:
        if asked(q):
            u = np.array(ok[q])
            near = [(-float((u * np.array(v)).sum() / np.sqrt((u * u).sum() * (np.array(v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(u)]
            out[q] = sorted((round(s, 12), i) for s, i in near)[:k]
    return out


@pytest.mark.parametrize("tile,stripe", [(1024, 8192), (3, 16)])
def test_nearest_equals_brute_force(spark, tile, stripe):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=24).astype("f4").tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] * 24), (2200, [None] + [1.0] * 23), (2250, [float("inf")] * 24), (None, rows[0][1])]
    rows += [(100, rows[100][1]), (2300, [1.0, 2.0]), (2350, [2.0, 1.0]), (2400, (np.array(rows[7][1]) * 1e30).tolist()), (2450, (np.array(rows[8][1]) * 1e-30).tolist())]
    df = spark.createDataFrame(rows, ROWS).withColumn("query", F.lit("x")).withColumn("stripe", F.lit(1)).withColumn("score", F.lit(2))
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 50 == 0, query_tile=tile, stripe=stripe).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = slow(rows, lambda q: q % 50 == 0, 5)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, len(near) + 1))
        assert [x[1] for x in near] == [i for _, i in want[q]]
        assert np.allclose([x[2] for x in near], [-s for s, _ in want[q]], atol=1e-9)


def test_few_rows_and_none(spark):
    assert N.nearest(spark.createDataFrame([], ROWS), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(spark.createDataFrame([(0, [1.0, 2.0])], ROWS), F.col("vec_id") % 50 == 0).count() == 0
    got = N.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], ROWS), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]


def test_quantised_scores_keep_their_bound():
    rnd = np.random.default_rng(2)
    a, b = (N.Tile(np.arange(n), rnd.normal(size=(n, 700)) ** 3) for n in (40, 50))
    score, bound = N.quantised_scores(a, b)
    i, j = np.indices(score.shape).reshape(2, -1)
    exact = N.cosines(a, i, b, j).reshape(score.shape)
    assert (np.abs(exact - score) <= bound).all() and bound.max() < 0.2
