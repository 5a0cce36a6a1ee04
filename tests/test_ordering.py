"""One order of a whole table, and medians from it, equal those of sorted lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraweave.operators import joins, ordering


def test_numbers_follow_the_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(a), None if a == 3 else float(b)) for k, (a, b) in enumerate(zip(rng.integers(0, 9, 500), rng.integers(0, 40, 500)))]
    df = spark.createDataFrame(rows, "id long, a int, b double").repartition(7)
    got = ordering.numbered(df, "a", "b", "id", total="all").collect()
    want = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == [r[0] for r in want] and {r["all"] for r in got} == {500}
    assert ordering.numbered(df.limit(0), "a").count() == 0


@pytest.mark.parametrize("values", [[], [None], [2.0], [1.0, 4.0], [5.0] * 7, [1.0, None, 9.0, 2.0, 2.5, -3.0, 40.0, 2.2]])
def test_statistics_of_all_rows(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    x = np.array([v for v in values if v is not None])
    middle = ordering.global_median(df, F.col("v")).first()[0]
    assert middle == (pytest.approx(np.median(x)) if len(x) else None)
    r = ordering.global_biweight(df, F.col("v")).first()
    if len(x) < 2 or not np.median(np.abs(x - np.median(x))):
        assert r.location == middle and r.scale is None
    else:
        d = x - np.median(x)
        u = (d / (9 * np.median(np.abs(d)))) ** 2
        d, u = d[u < 1], u[u < 1]
        assert r.location == pytest.approx(np.median(x) + (d * (1 - u) ** 2).sum() / ((1 - u) ** 2).sum())
        assert r.scale == pytest.approx(np.sqrt(len(d) * (d**2 * (1 - u) ** 4).sum()) / abs(((1 - u) * (1 - 5 * u)).sum()))
        assert ordering.global_mad_std(df, F.col("v")).first()[0] == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))


@pytest.mark.parametrize("mode,tolerance", [("backward", None), ("backward", 40.0), ("nearest", None), ("nearest", 25.0)])
def test_asof_by_buckets_is_asof(spark, mode, tolerance):
    rng = np.random.default_rng(4)
    at = lambda n: [(int(k), int(u), float(t)) for k, (u, t) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 900, n)))]
    left, right = (spark.createDataFrame(at(n), "id long, u int, s double").withColumn("ts", F.timestamp_seconds("s")) for n in (150, 25))
    # a key of which all right rows lie in far buckets
    right = right.unionByName(spark.createDataFrame([(99, 7, 0.0)], "id long, u int, s double").withColumn("ts", F.timestamp_seconds("s")))
    left = left.unionByName(spark.createDataFrame([(999, 7, 880.0)], "id long, u int, s double").withColumn("ts", F.timestamp_seconds("s")))
    found = lambda bucket: {r.id: r.match for r in joins.asof(left, right, ["u"], "ts", "id", "id", mode, tolerance, bucket=bucket).collect()}
    want = found(None)
    assert len(want) == 151 and found(60.0) == want and found(1e6) == want and (tolerance or want[999] == 99)


def test_quantiles_are_counted_not_sorted(spark, monkeypatch):
    rng = np.random.default_rng(8)
    wide = [float(v) for v in rng.lognormal(0, 6, 400)]
    groups = {1: wide, 2: [3.0] * 300, 3: [1.0, 2.0] * 150 + [9.0], 4: [7.0], 5: [-math.inf, *wide[:50], math.inf], 6: [], 7: [*wide[:40], math.nan], None: [1.0]}
    rows = [(k, v) for k, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    monkeypatch.setattr(ordering, "_BINS", 7)
    monkeypatch.setattr(ordering, "_SORTED", 5)
    out = ordering.quantiles(df, ["k"], F.col("v"), [0.0, 0.05, 0.5, 1.0])
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r.k: r.q for r in out.collect()}
    want = {r.k: r.q for r in df.where("k is not null and v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.05, 0.5, 1.0)))).alias("q")).collect()}
    assert set(got) == set(want) == {1, 2, 3, 4, 5, 7}
    for k, q in got.items():
        assert q == pytest.approx(want[k], nan_ok=True)
