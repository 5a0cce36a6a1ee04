"""Models of light and levels against brute force and planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraweave.operators import models, robust


def test_clip_to_convergence(spark):
    rng = np.random.default_rng(6)
    groups = {0: [1.0], 1: [2.0] * 5, 2: rng.normal(0, 1, 50).tolist(), 3: [1.0, 2.0, 3.0], 5: [None, 4.0]}
    # wide wings: each round takes the farthest few
    groups[4] = [float(np.tan(np.pi * (u - 0.5))) for u in np.linspace(0.005, 0.995, 199)]
    rounds = {}
    want = {}
    for g, xs in groups.items():
        x = np.array([np.nan if v is None else v for v in xs], float)
        rounds[g] = 0
        while True:
            m = np.nanmedian(x)
            s = 1.4826 * np.nanmedian(np.abs(x - m))
            new = np.where(np.abs(x - m) <= 2.5 * s, x, np.nan)
            rounds[g] += 1
            if np.isnan(new).sum() == np.isnan(x).sum():
                break
            x = new
        want |= {(g, k): None if np.isnan(v) else float(v) for k, v in enumerate(x)}
    assert min(rounds.values()) == 1 and max(rounds.values()) >= 4
    df = spark.createDataFrame([(g, k, v) for g, xs in groups.items() for k, v in enumerate(xs)], "g int, k int, x double")
    assert {(r.g, r.k): r.clipped for r in robust.sigma_clip_converged(df, ["g"], "x", 2.5).collect()} == want
    assert robust.sigma_clip_converged(df.limit(0), ["g"], "x").count() == 0


def test_scattered_light_of_a_smooth_field(spark):
    rows, cols = 120, 100
    y, x = np.indices((rows, cols))
    smooth = 50 + 0.02 * x + 0.015 * y + 0.0001 * (x - 50) * (y - 60)
    image, trace = smooth.copy(), []
    for f, t0 in enumerate((20, 24, 28, 60, 64, 68, 100, 104)):
        t = t0 + 0.02 * np.arange(cols)
        image += 300 * np.exp(-0.5 * ((y - t) / 1.3) ** 2)
        trace += [("A", f, c, float(t[c])) for c in range(cols)]
    frame = spark.createDataFrame([("A", r, c, float(image[r, c])) for r in range(rows) for c in range(cols)], "amp string, row int, col int, v double").repartition(3)
    out = models.scattered_light(frame, spark.createDataFrame(trace, "amp string, fiber int, col int, trace double"), ["amp"], "v", 40, sigma=12.0).collect()
    off = np.array([r.scattered / smooth[r.row, r.col] - 1 for r in out])
    assert len(out) == rows * cols and np.abs(off).max() < 0.01
    none = models.scattered_light(frame, spark.createDataFrame([], "amp string, fiber int, col int, trace double"), ["amp"], "v", 40)
    assert none.where("scattered is not null").count() == 0


def test_penalised_levels_try_all_steps(spark):
    rng = np.random.default_rng(7)
    data = {(a, f): 10 * (1 + 0.03 * rng.standard_normal(24)) for a in "xy" for f in range(6)}
    df = spark.createDataFrame([("e", a, f, i, float(v)) for (a, f), xs in data.items() for i, v in enumerate(xs)], "e string, a string, f int, i int, v double")
    got = {(r.a, r.f, r.chunk): r.ratio for r in models.penalised_levels(df, ["e"], "a", "f", "i", "v", chunks=3, width=3).collect()}
    for c, part in enumerate(np.array_split(np.arange(24), 3)):
        mid = np.median([data[k][part] for k in data])
        x = {k: np.median(v[part]) for k, v in data.items()}
        now = dict.fromkeys(data, mid)
        for _ in range(3):
            amp = {a: np.median([now[k] for k in now if k[0] == a]) for a in "xy"}
            steps = mid * (1 + 0.005 * np.arange(-10, 11))
            now = {k: steps[np.argmin(np.round((x[k] - steps) ** 2 + (steps - amp[k[0]]) ** 2, 12))] for k in now}
        for (a, f), _ in data.items():
            near = [now[a, g] for g in range(max(0, f - 1), min(6, f + 2))]
            assert got[a, f, c] == pytest.approx(np.mean(near) / mid, abs=1e-9)


def test_gaps_from_the_readout_side(spark):
    rng = np.random.default_rng(9)
    data = np.where(rng.random((30, 12)) < np.linspace(0.05, 0.7, 12), np.nan, 1.0)
    df = spark.createDataFrame([(0, r, c, None if np.isnan(data[r, c]) else 1.0) for r in range(30) for c in range(12)], "k int, r int, c int, v double")
    want = data.copy()
    for j in range(28):
        for c in range(12):
            if np.isnan(want[j, c]) and np.isnan(want[j:, c]).sum() > (30 - j) / 3:
                want[j:, c] = np.nan
    got = {(r.r, r.c): r.kept for r in models.readout_gaps(df, ["k"], "r", "c", "v").collect()}
    assert all((got[r, c] is None) == np.isnan(want[r, c]) for r in range(30) for c in range(12)) and np.isnan(want).sum() > np.isnan(data).sum()


def test_smoothing_in_two_passes_is_that_of_the_plane(spark):
    rng = np.random.default_rng(3)
    data = np.where(rng.random((9, 11)) < 0.3, np.nan, rng.random((9, 11)))
    df = spark.createDataFrame([(0, r, c, None if np.isnan(data[r, c]) else float(data[r, c])) for r in range(9) for c in range(11)], "k int, r int, c int, v double")
    y, x = np.indices(data.shape)
    for r in models.smooth_grid(df, ["k"], "r", "c", "v", 1.0).collect():
        w = np.exp(-0.5 * ((y - r.r) ** 2 + (x - r.c) ** 2)) * ~np.isnan(data) * (abs(y - r.r) <= 4) * (abs(x - r.c) <= 4)
        assert r.smoothed == pytest.approx((np.nan_to_num(data) * w).sum() / w.sum())


def test_holes_take_the_nearest_cell(spark):
    rng = np.random.default_rng(1)
    data = np.where(rng.random((12, 15)) < 0.8, np.nan, rng.random((12, 15)))
    rows = [(0, r, c, None if np.isnan(data[r, c]) else float(data[r, c])) for r in range(12) for c in range(15)] + [(1, r, c, None) for r in range(2) for c in range(2)]
    valid = [(r, c) for r in range(12) for c in range(15) if not np.isnan(data[r, c])]
    for r in models.nearest_filled(spark.createDataFrame(rows, "k int, r int, c int, v double"), ["k"], "r", "c", "v").collect():
        if r.k:
            assert r.filled is None
        else:
            best = min(valid, key=lambda p: ((p[0] - r.r) ** 2 + (p[1] - r.c) ** 2, *p))
            assert r.filled == data[best]


def test_profile_from_many_phases(spark):
    rng = np.random.default_rng(2)
    shape = lambda d: np.exp(-0.5 * (d / 1.6) ** 2)
    trace = [(0, f, c, 8 + 15 * f + 0.13 * c) for f in range(6) for c in range(30)]
    flux = {(f, c): float(50 + 20 * rng.random()) for f in range(6) for c in range(30)}
    pixels = {}
    for _, f, c, t in trace:
        for r in range(int(t) - 8, int(t) + 10):
            pixels[r, c] = pixels.get((r, c), 0.0) + flux[f, c] * shape(r - t)
    frame = spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in pixels.items() if r >= 0], "k int, row int, col int, v double")
    spec = spark.createDataFrame([(0, f, c, v) for (f, c), v in flux.items()], "k int, fiber int, col int, flux double")
    samples = models.profile_samples(frame, spark.createDataFrame(trace, "k int, fiber int, col int, trace double"), spec, ["k"], "v", "flux")
    got = models.stacked_profile(samples, ["k"], "offset", "share").collect()
    assert len(got) == 25 and all(abs(r.y - shape(r.x)) < 0.02 for r in got)


def test_samples_without_a_copy_of_the_trace_for_each_pixel(spark):
    frame = spark.createDataFrame([(0, r, 0, float(r)) for r in range(-30, 80)], "k int, row int, col int, v double")
    places = [-20.5, 5.5, 23.0, 24.0, 41.7, 79.2]
    trace = spark.createDataFrame([(0, n, 0, t) for n, t in enumerate(places)] + [(0, 9, 0, None)], "k int, fiber int, col int, trace double")
    spec = spark.createDataFrame([(0, n, 0, 2.0) for n in range(6)], "k int, fiber int, col int, flux double")
    out = models.profile_samples(frame, trace, spec, ["k"], "v", "flux")
    got = sorted((r.fiber, round(r.offset + places[r.fiber]), r.share) for r in out.collect())
    assert got == [(n, r, r / 2) for n, t in enumerate(places) for r in range(-30, 80) if abs(r - t) <= 6]
    # what is exploded are the stretches of rows, not the rows
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Generate" in line] and all("__part" in line for line in plan.splitlines() if "Generate" in line)


def test_model_image(spark):
    rows, cols = 40, 6
    wave = lambda r, c: 100 + 2 * c + 0.3 * r + 0.002 * r * r
    trace = [(0, c, float(t), float(wave(t, c)), float(t - 0.1 * c)) for c in range(cols) for t in np.arange(1.3, 39, 3.7)]
    points = spark.createDataFrame(trace, "k int, col int, at double, wave double, first double")
    pixels = spark.createDataFrame([(0, r, c) for r in range(rows) for c in range(cols)], "k int, row int, col int")
    waves = models.column_surface(points, pixels, ["k"], "at", "wave")
    fibers = models.column_surface(points, pixels, ["k"], "at", "first")
    spectrum = spark.createDataFrame([(0, 90.0 + 0.5 * n, float(np.sin(n / 9))) for n in range(100)], "k int, wave double, flux double")
    levels = spark.createDataFrame([(0, -2.0 + n, 1 + 0.01 * n) for n in range(50)], "k int, at double, level double")
    got = models.model_image(waves, fibers, spectrum, levels, ["k"], (90.0, 0.5), (-2.0, 1.0)).collect()
    assert len(got) == rows * cols
    for r in got:
        light = np.interp(wave(r.row, r.col), 90 + 0.5 * np.arange(100), np.sin(np.arange(100) / 9))
        level = np.interp(r.row - 0.1 * r.col, np.arange(50) - 2.0, 1 + 0.01 * np.arange(50))
        assert r.model == pytest.approx(light * level, abs=1e-5)
    few = models.column_surface(points.limit(3), pixels, ["k"], "at", "wave")
    assert few.where("surface is not null").count() == 0 and few.count() == rows * cols


def test_what_an_amplifier_leaves(spark):
    rng = np.random.default_rng(11)
    n, bins = 14, 70
    pattern = np.sin(np.arange(bins) / 2.0)
    left = 0.5 + np.outer(rng.normal(0, 2, n), pattern)  # a level, and one curve that each fiber has in its own strength
    data = left + 0.05 * rng.standard_normal((n, bins))
    rows = [("A", f, i, None if (f, i) == (3, 9) else float(data[f, i]), 1.0, (f, i) in ((5, 30), (5, 31))) for f in range(n) for i in range(bins)]
    rows = [(a, f, i, 90.0 if m else v, e, m) for a, f, i, v, e, m in rows]
    df = spark.createDataFrame(rows, "amp string, fiber int, i int, v double, e double, bad boolean").repartition(3)
    out = models.amp_residual(df, ["amp"], "fiber", "i", "v", "e", F.col("bad"), bins=5).collect()
    assert len(out) == n * bins and sum(r.residual is None for r in out) == 1
    off = [r.residual - left[r.fiber, r.i] for r in out if r.residual is not None and r.fiber != 5]
    assert np.std(off) < 0.35 * left.std() and abs(np.median(off)) < 0.1
