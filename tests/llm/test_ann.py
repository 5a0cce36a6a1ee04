import math

import numpy as np
from pyspark.sql import functions as F

from spectraweave.llm import ann
from spectraweave.llm.queries import op10_nearest


def by_hand(rows, queries, k=5):
    out = {}
    for q, x in queries:
        x = np.array(x, float)
        best = [(-(x @ y) / math.sqrt(x @ x) / math.sqrt(y @ y), i) for i, y in ((i, np.array(y, float)) for i, y in rows) if i != q]
        out[q] = [i for s, i in sorted((round(s, 12), i) for s, i in best)[:k]]
    return out


def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = by_hand(rows, [r for r in rows if r[0] % 50 == 0])
    got = op10_nearest(spark, sf).collect()
    assert len(got) == 5 * len(want)
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.95 * len(got)
    vec = dict(rows)
    for r in got:
        a, b = np.array(vec[r.query_id], float), np.array(vec[r.vec_id], float)
        assert abs(r.score - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-14


def test_clustered_rows_in_several_shards_and_blocks(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    vecs = centres[rng.integers(20, size=2000)] + 0.3 * rng.standard_normal((2000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), shard_rows=500, query_rows=30, verified_col="verified").collect()
    want = by_hand(rows, rows[::20])
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.92 * 500 and len(got) == 500
    # the stopping test ends most searches early
    assert sum({r.query_id: r.verified for r in got}.values()) < 0.3 * 100 * 2000


def test_tree_meets_rows_in_order():
    points = np.random.default_rng(1).standard_normal((900, 4))
    tree, p = ann.Tree(points, leaf=16), np.array([0.1, -0.2, 0.3, 0.0])
    met, last = [], 0.0
    for bound, rows, d in tree.neighbours(p):
        assert (d >= last - 1e-12).all() and np.allclose(d, ((points[rows] - p) ** 2).sum(axis=1))
        met, last = [*met, *rows], bound
    assert sorted(met) == list(range(900)) and last == math.inf
    assert abs(ann.chi2_cdf(ann.chi2_limit(0.9, 8), 8) - 0.9) < 1e-9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 1e300]), (10, [1e-300, 0.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (100, 1, 9), (100, 2, 0), (100, 3, 1)]
    assert [r.score for r in got] == [1.0, 1.0, 1.0, 1.0, 0.0, 0.0]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.1), F.lit(0.7), F.lit(0.2)).alias("embedding"))
    got = ann.nearest(same, same.where("vec_id in (0, 50)"), shard_rows=700).collect()
    assert {(r.query_id, r.vec_id) for r in got} == {(0, i) for i in range(1, 6)} | {(50, i) for i in range(5)}
