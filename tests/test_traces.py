"""Planted traces, arcs and wavelengths come back."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraweave.operators import lineage, traces, wavelengths
from spectraweave.plans.trace_queries import TRACE, fit_fiber_traces, places
from spectraweave.plans.wavelength_queries import LINES, at_column, fit_wavelength_map


def test_tilted_traces_and_a_dead_fiber(spark):
    rng = np.random.default_rng(3)
    rows, cols, n = 130, 80, 12
    frames, where, truth = [], [], {}
    for amp, dead, listed in (("LL", {4}, {4}), ("RU", set(), {7})):  # a fiber listed as dead may be found alive
        image = 5 + 0.01 * np.arange(rows)[:, None] + rng.normal(0, 0.05, (rows, cols))
        x = np.arange(cols)
        for f in range(n):
            t = 8 + 10 * f + 0.02 * (x - 40) + 0.0003 * (x - 40) ** 2
            truth[amp, f] = t
            image += 0 if f in dead else (40 + 3 * f) * np.exp(-0.5 * ((np.arange(rows)[:, None] - t) / 1.8) ** 2)
            where.append((amp, f, 8.0 + 10 * f, int(f in listed)))
        frames += [(amp, r, c, float(image[r, c])) for r in range(rows) for c in range(cols)]
    frame = spark.createDataFrame(frames, "amp string, row int, col int, flux double").repartition(3)
    got = traces.fiber_traces(frame, spark.createDataFrame(where, "amp string, fiber int, position double, dead int"), ["amp"], "flux", chunks=10, window=61).collect()
    assert len(got) == 2 * n * cols
    for r in got:
        assert abs(r.trace - truth[r.amp, r.fiber][r.col]) < (0.05 if (r.amp, r.fiber) != ("LL", 4) else 0.1)
    none = traces.fiber_traces(frame.limit(0), spark.createDataFrame([], "amp string, fiber int, position double, dead int"), ["amp"], "flux")
    assert none.columns == ["amp", "fiber", "col", "trace"] and none.count() == 0


def test_even_chunks_are_those_of_an_even_split(spark):
    for n, k in ((13, 4), (64, 8), (5, 7)):
        got = [r[0] for r in spark.range(n).orderBy("id").select(traces.even_chunk(F.col("id"), F.lit(n), k)).collect()]
        assert got == [c for c, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]


def test_registered_traces_are_those_of_the_made_frame(spark, sf):
    got = fit_fiber_traces(spark, sf).join(places(spark, sf), ["exp", "fiber"]).withColumn("t", F.expr(TRACE.replace("rw", "fiber").replace("idx", "col")))
    worst = got.groupBy("dead").agg(F.max(F.abs(F.col("trace") - F.col("t"))).alias("worst"), F.count("*").alias("n")).collect()
    assert sorted((r.dead, r.n) for r in worst) == [(0, 480 * 64), (1, 20 * 64)]
    assert all(r.worst < 0.1 for r in worst)  # chunks of eight columns: the ends are a little off


def planted(rng, missing=(), false=()):
    """Peaks of the lines at 2 A a pixel, with a bend."""
    t = (np.array(LINES) - 3500) / 2000
    x = 12 + 985 * t + 14 * t**2 - 5 * t**3
    heights = [400, 300, 900, 700, 500, 650, 120, 800, 600]
    out = [(x[k] + rng.normal(0, 0.02), float(heights[k])) for k in range(9) if k not in missing]
    return x, out + list(false)


def test_arcs_with_false_and_missing_peaks(spark):
    rng = np.random.default_rng(5)
    cases = {0: planted(rng), 1: planted(rng, (6,), [(700.0, 90.0)]), 2: planted(rng, (), [(150.0, 60.0), (333.0, 80.0), (901.0, 40.0)]), 3: planted(rng, (0, 1, 2, 3, 4, 5))}
    rows = [(f, float(x), h) for f, (_, peaks) in cases.items() for x, h in peaks]
    solutions, matches = wavelengths.identify_arc(spark.createDataFrame(rows, "fiber int, x double, h double"), ["fiber"], "x", "h", LINES)
    got = {r.fiber: r for r in solutions.collect()}
    assert set(got) == {0, 1, 2} and all(r.rms < 0.1 for r in got.values()) and [got[f].n_match for f in range(3)] == [9, 8, 9]
    for f in range(3):
        u = (cases[f][0] - got[f].mid) / got[f].half
        at = np.polynomial.polynomial.polyval(u, got[f].coef)
        assert np.abs(at - LINES)[[k for k in range(9) if f != 1 or k != 6]].max() < 0.2
    for r in matches.collect():
        assert abs(r.x - cases[r.fiber][0][LINES.index(r.line)]) < 0.1


def test_quadratic_in_closed_form(spark):
    u = [-1.0, -0.4, 0.1, 0.7, 1.0]
    y = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([(u, y), ([0.5, 0.5, 0.5], [1.0, 2.0, 3.0])], "u array<double>, y array<double>")
    a, b = (r[0] for r in df.select(wavelengths.quadratic(F.col("u"), F.col("y"))).collect())
    assert a == pytest.approx(np.polynomial.polynomial.polyfit(u, y, 2)) and b == [None] * 3


def test_wavelength_map_from_an_eighth_of_the_fibers(spark, sf):
    got = fit_wavelength_map(spark, sf)
    inside = got.where("wave between 3611 and 5460").withColumn("x", F.expr(at_column("wave", "fiber")))
    r = inside.agg(F.max(F.abs(F.col("x") - F.col("col"))).alias("worst"), F.countDistinct("exp", "fiber").alias("n")).first()
    sizes = [r[0] for r in places(spark, sf).groupBy("exp").count().select("count").collect()]
    enough = [n for n in sizes if len({*range(2, n, 8), n - 3}) >= 7]  # with fewer seeds an exposure has no map
    assert r.n == sum(enough) and len(enough) >= 8 and r.worst < 0.1


def test_pedestal_is_measured_once_and_dead_fibers_look_from_the_end(spark):
    rows = [("a", 0, 0.0, r, 1.0 + r % 8) for r in range(40)]
    profiles = spark.createDataFrame(rows, "amp string, chunk int, at double, row int, flux double")
    clean = traces.without_pedestal(profiles, ["amp", "chunk"], "flux", window=9)
    assert "percentile" not in clean._jdf.queryExecution().optimizedPlan().toString()  # else for each of the fit's three readings
    peaks = spark.createDataFrame([("a", 0, 0.5, r, 2.0, float(r)) for r in (8, 24)], "amp string, chunk int, at double, row int, height double, peak double")
    where = spark.createDataFrame([("a", 0, 0.0, 1), ("a", 1, 8.0, 0), ("a", 2, 16.5, 1), ("a", 3, 24.0, 0), ("a", 4, 32.0, 1)], "amp string, fiber int, position double, dead int")
    out = traces.fiber_peaks(peaks, where, ["amp"])
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.fiber, r.trace) for r in out.collect()) == [(0, 0.0), (1, 8.0), (2, 16.5), (3, 24.0), (4, 32.0)]


def hints(df):
    """The strategies of the joins' sides, as asked for."""
    return re.findall(r"(left|right)Hint=\(strategy=(\w+)\)", df._jdf.queryExecution().optimizedPlan().toString())


def test_profiles_and_traces_broadcast_no_table_that_follows_the_frames(spark, monkeypatch):
    frame = spark.createDataFrame([(a, r, c, float(r + c)) for a in "ab" for r in range(5) for c in range(8)], "amp string, row int, col int, flux double")
    profiles = traces.chunk_profiles(frame, ["amp"], "flux", 2)
    assert hints(profiles) == [("right", "broadcast")]  # the one row a frame; else the planner may take the frame itself
    want = sorted(map(tuple, profiles.collect()))
    monkeypatch.setattr(lineage, "FEW", 1)
    many = traces.chunk_profiles(frame, ["amp"], "flux", 2)
    assert hints(many) == [("right", "shuffle_hash")] and sorted(map(tuple, many.collect())) == want and len(want) == 20
    peaks = spark.createDataFrame([("a", 0, 0.5, r, 2.0, float(r)) for r in (8, 24)], "amp string, chunk int, at double, row int, height double, peak double")
    where = spark.createDataFrame([("a", 1, 8.0, 0), ("a", 2, 16.5, 1), ("a", 3, 24.0, 0)], "amp string, fiber int, position double, dead int")
    out = traces.fiber_peaks(peaks, where, ["amp"])
    assert {h for _, h in hints(out)} == {"shuffle_hash"} and out.count() == 3


def test_wavelength_map_broadcasts_no_pixels(spark, monkeypatch):
    rows = spark.createDataFrame([("a", f, c, float(c % 7)) for f in range(6) for c in range(8)], "amp string, fiber int, col int, flux double")
    assert hints(wavelengths.seed_spectra(rows, ["amp"], "flux")) == [("right", "broadcast")]
    named = []
    monkeypatch.setattr(wavelengths, "few", lambda df: named.append(df.columns) or lineage.few(df))
    out = wavelengths.wavelength_map(rows, rows.withColumn("trace", F.col("fiber") + 0.5), ["amp"], "flux", LINES)
    assert named == [["amp", "__last"], ["amp", "__last"], ["amp", "fiber", "n_last", "coef", "n"]]
    assert set(hints(out)) == {("right", "broadcast")} and out.count() == 0
