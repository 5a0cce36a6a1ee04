"""Operators whose work must not grow with the square of a dense field's rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraweave.operators import amps, extraction, grid, joins, models
from spectraweave.plans import all_queries


@pytest.fixture()
def pairs(monkeypatch):
    """Counts of the pairs that within_radius makes."""
    made, plain = [], joins.within_radius

    def counted(*args, **kwargs):
        out = plain(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(joins, "within_radius", counted)
    return made


def field(spark, n, seed):
    """Positions crowded about a point, every tenth one a copy of another, some far off, one missing."""
    r = np.random.default_rng(seed)
    ra, dec = 359.9999 + r.normal(0, 0.002, n), 2 + r.normal(0, 0.002, n)
    ra[::10], dec[::10] = ra[1], dec[1]
    ra[2:6] += [0.01, 0.03, 0.1, 1.0]
    ra = ra % 360
    return spark.createDataFrame([(k, None if k == 7 else float(a), float(d)) for k, (a, d) in enumerate(zip(ra, dec))], "id long, ra double, dec double"), ra, dec


def nearest(ra, dec, ra2, dec2, most):
    d = np.radians(dec2[None] - dec[:, None]) / 2
    h = np.sin(d) ** 2 + np.cos(np.radians(dec))[:, None] * np.cos(np.radians(dec2))[None] * np.sin(np.radians(ra2[None] - ra[:, None]) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(h)))) * 3600
    sep[7], sep[:, 7] = np.inf, np.inf
    return sep.min(1), sep <= most


def test_nearest_match_in_a_dense_field(spark, pairs):
    n = 1500
    (a, ra, dec), (b, ra2, dec2) = field(spark, n, 1), field(spark, n, 2)
    sep, _ = nearest(ra, dec, ra2, dec2, 45.0)
    got = sorted(joins.nearest_match(a, b, "id", "id", 45.0).collect())
    assert len(got) == n
    for r in got:
        if sep[r.id] <= 45:
            assert r.sep == pytest.approx(sep[r.id], abs=1e-7)
            copies = np.flatnonzero((ra2 == ra2[r.match]) & (dec2 == dec2[r.match]))
            assert r.match == copies[0]
        else:
            assert r.match is None and r.sep is None and r.dra is None
    assert sum(pairs) < 60 * n


def test_flag_near_in_a_dense_field(spark, pairs):
    n = 1500
    (a, ra, dec), (b, ra2, dec2) = field(spark, n, 3), field(spark, n, 4)
    sep, near = nearest(ra, dec, ra2, dec2, 30.0)
    got = {r.id: r.near for r in joins.flag_near(a, b, 30.0, "id").collect()}
    assert got == {k: bool(near[k].any()) for k in range(n)}
    assert sum(pairs) < 60 * n


def test_nearest_filled_looks_close_by_first(spark):
    # a stretch without values that takes several reaches, and a frame with none
    g = np.random.default_rng(6)
    rows = [(0, r, c, None if 10 <= r < 60 or g.random() < 0.4 else float(g.normal())) for r in range(90) for c in range(4)] + [(1, r, 0, None) for r in range(3)]
    df = models.nearest_filled(spark.createDataFrame(rows, "k int, r int, c int, v double"), ["k"], "r", "c", "v")
    known = [(r, c, v) for k, r, c, v in rows if v is not None]
    for x in df.collect():
        want = x.v if x.v is not None else min(((r - x.r) ** 2 + (c - x.c) ** 2, r, c, v) for r, c, v in known)[3] if x.k == 0 else None
        assert x.filled == want
    # no list of a whole column
    assert "collect_" not in df._jdf.queryExecution().toString()


def plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_no_frame_to_the_last_row(spark):
    # Spark goes through such a frame anew for every row
    s = spark.createDataFrame([(0, float(w), 2.0 * w) for w in range(20)], "k int, w double, v double")
    out = amps.at_wavelengths(s.withColumn("w", F.col("w") + 0.25), s, ["k"], "w", ["v"])
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    assert [r["__tv"] for r in sorted(out.collect())] == [pytest.approx(2 * w + 0.5) for w in range(19)] + [None]
    rows = [(0, r, c, None if 4 <= r < 8 and c == 1 else 1.0) for r in range(12) for c in range(2)]
    out = models.readout_gaps(spark.createDataFrame(rows, "k int, r int, c int, v double"), ["k"], "r", "c", "v")
    assert "currentrow$(), unboundedfollowing" not in plan(out)
    assert {(r.r, r.c) for r in out.collect() if r.kept is None} == {(r, 1) for r in range(4, 12)}


def test_small_inputs_are_dealt_to_all_tasks(spark, sf):
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("grd_fiber_weights", "grd_extract_sources", "grd_normalised_sources"):
        assert f", {tasks}), repartition_by_num" in plan(all_queries()[0][name](spark, sf))


def test_arcs_are_dealt_to_all_tasks(spark, sf):
    assert f", {spark.conf.get('spark.sql.shuffle.partitions')}), repartition_by_num" in plan(all_queries()[0]["fit_arc_subsets"](spark, sf))


@pytest.mark.parametrize("variance", [False, True])
def test_smooth_2d_copies_along_one_axis_at_a_time(spark, monkeypatch, variance):
    copies, plain = [], F.explode

    def counted(array):
        copies.append(spark.range(1).select(F.size(array)).first()[0])
        return plain(array)

    monkeypatch.setattr(F, "explode", counted)
    r, reach, sigma = np.random.default_rng(4), 3, 1.2
    cells = [(k % 2, int(x), int(y), None if x == y else float(r.normal())) for k, (x, y) in enumerate(r.integers(0, 12, (90, 2)))]
    cells = list({c[:3]: c for c in cells}.values())
    image = spark.createDataFrame(cells, "k int, px int, py int, v double")
    got = {tuple(row[:3]): row.smoothed for row in grid.smooth_2d(image, ["k"], "v", sigma, reach, variance=variance).collect()}
    assert len(got) == len(cells)
    for k, x, y, _ in cells:
        near = [(v, np.exp(-0.5 * ((a - x) ** 2 + (b - y) ** 2) / sigma**2)) for j, a, b, v in cells if j == k and v is not None and abs(a - x) <= reach and abs(b - y) <= reach]
        w = np.array([n[1] for n in near])
        want = (np.array([n[0] for n in near]) * (w * w if variance else w)).sum() / (w.sum() ** 2 if variance else w.sum()) if near else None
        assert got[k, x, y] == (None if want is None else pytest.approx(want, abs=1e-9))
    assert max(copies) == 2 * reach + 1


def test_weights_of_one_place_are_made_once(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    copies = spark.range(1101).withColumnRenamed("id", "copy")  # more than are copied at a time
    supplier = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey < 3").crossJoin(copies)
    supplier.withColumn("s_suppkey", F.col("s_suppkey") + 10 * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/supplier.parquet")
    samples, plain = [], extraction.fiber_weights
    monkeypatch.setattr(extraction, "fiber_weights", lambda rows, *a: samples.append(rows.count()) or plain(rows, *a))
    one = all_queries()[0]["grd_fiber_weights"](spark, sf).where("source < 3")
    many = all_queries()[0]["grd_fiber_weights"](spark, str(tmp_path))
    n, sums = one.count(), lambda df: sorted(map(tuple, df.groupBy((F.col("source") % 10).alias("s"), "fiber", "idx").agg(F.min("weight"), F.max("weight")).collect()))
    assert n and many.count() == 1101 * n and sums(many) == sums(one)
    assert samples[1] == n and many.select("source").distinct().count() == 1101 * one.select("source").distinct().count()
