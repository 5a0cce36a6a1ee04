"""Detections, extractions and tiles against planted truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraweave.operators import detection, extraction
from spectraweave.plans.extraction_queries import grd_detect_lines
from spectraweave.plans.registry import spectra

KERNEL = [float(np.exp(-0.5 * (j / 1.5) ** 2)) for j in range(-3, 4)]


def field(rng, lines, n=15, bins=90):
    cube = 1 + 0.3 * rng.standard_normal((n, n, bins))
    x, y, k = np.indices(cube.shape)
    for cx, cy, ck, wide, height in lines:
        cube += height * np.exp(-0.5 * ((x - cx) ** 2 + (y - cy) ** 2) / wide**2) * np.exp(-0.5 * ((k - ck) / 1.5) ** 2)
    return [(int(a), int(b), int(c), float(cube[a, b, c]), 0.3) for a in range(n) for b in range(n) for c in range(bins)]


@pytest.fixture(scope="module")
def cubes(spark):
    rng = np.random.default_rng(8)
    one = field(rng, [(4, 5, 20, 1.0, 20), (4, 5, 60, 1.0, 15), (10, 10, 40, 2.2, 12)])
    two = field(rng, [(7.4, 6.7, 30, 1.0, 20)])
    rows = [("a", *r) for r in one] + [("b", *r) for r in two]
    return spark.createDataFrame(rows, "f string, x long, y long, i int, v double, e double").repartition(4)


def found(df, keys):
    out = detection.detect_lines(df, ("x", "y", "i"), "v", "e", 5, KERNEL, threshold=7.0, keys=keys)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect()), key=str), out.columns


def test_lines_at_one_place_and_a_broad_source(cubes):
    got, columns = found(cubes, ["f"])
    rows = [dict(zip(columns, r)) for r in got]
    a = sorted((r for r in rows if r["f"] == "a"), key=lambda r: r["i"])
    assert [(round(r["xc"]), round(r["yc"])) for r in a] == [(4, 5), (10, 10), (4, 5)]
    assert all(abs(r["centre"] - k) < 0.6 for r, k in zip(a, (20, 40, 60))) and all(abs(r["width"] - 1.5) <= 0.5 for r in a)
    assert all(abs(r["amplitude"] / h - 1) < 0.15 for r, h in zip((a[0], a[2]), (20, 15)))
    (b,) = [r for r in rows if r["f"] == "b"]
    assert abs(b["xc"] - 7.4) < 0.15 and abs(b["yc"] - 6.7) < 0.15
    # two fields in one call give what a call for each gives
    for f in "ab":
        assert [r for r in got if r[0] == f] == [(f, *r) for r in found(cubes.where(F.col("f") == f), [])[0]]
    assert found(cubes.limit(0), ["f"])[0] == []
    assert detection.detect_lines(cubes, ("x", "y", "i"), "v", "e", 5, KERNEL, threshold=7.0, keys=["f"], most=3).count() == 0


def test_registered_lines_are_those_planted(spark, sf):
    got = {(r.field, r.x, r.y, r.idx) for r in grd_detect_lines(spark, sf).collect()}
    lines = [r[0] for r in spectra(spark, sf).where("idx = 0 and fiber % 250 in (24, 137)").select("fiber").collect()]
    want = {(f % 2, f // 2 % 25, f // 50, 12 + f * 7 % 40) for f in lines}
    near = lambda a, b: a[0] == b[0] and all(abs(p - q) <= 1 for p, q in zip(a[1:], b[1:]))
    assert len(want) == 4 and all(any(near(w, g) for g in got) for w in want) and len(got) <= 8


def test_groups_of_points(spark):
    rng = np.random.default_rng(2)
    points = [(int(k), float(x), float(y)) for k in range(2) for x, y in rng.uniform(0, 40, (120, 2))]
    df = spark.createDataFrame(points, "k int, x double, y double").repartition(3)
    got = detection.linked_groups(df, ["k"], ["x", "y"], [1.0, 2.0], 3.0).collect()
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j, b in enumerate(points[:i]):
            if a[0] == b[0] and (a[1] - b[1]) ** 2 + 4 * (a[2] - b[2]) ** 2 <= 9:
                root[top(i)] = top(j)
    place = {p: top(i) for i, p in enumerate(points)}
    pairs = {((r.k, r.group), place[r.k, r.x, r.y]) for r in got}
    assert len(got) == len(points) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


PROFILE = extraction.Profile(extraction.aperture_grid(12, (1.5, 2.0, 2.5), 3.5, 0.5), [3600.0 + 100 * k for k in range(8)], 0.5, 1.5, 0.5)


def fibers(spark, shots=("s1", "s2"), n=14):
    rng = np.random.default_rng(4)
    rows = []
    for s in shots:
        for k in range(n * n):
            x, y = 1.3 * (k % n) - 8, 1.3 * (k // n) - 8
            flux = [float(v) for v in 1 + rng.standard_normal(8)]
            if k == 40:
                flux[3] = None
            rows.append((s, k, 150 + x / 3600, y / 3600, flux if k != 77 else None, [0.5] * 8, 1.8))
    return spark.createDataFrame(rows, "shot string, fiber int, ra double, dec double, flux array<double>, error array<double>, seeing double").repartition(5)


def by_hand(rows, ra, dec, radius):
    num, den, var, tot = (np.zeros(8) for _ in range(4))
    for r in rows:
        dx, dy = (r.ra - ra) * np.cos(np.radians(dec)) * 3600, (r.dec - dec) * 3600
        if r.flux is None or np.hypot(dx, dy) > radius:
            continue
        g = PROFILE.weights(*(np.array([v]) for v in (dx, dy, r.seeing, 20.0)))[0]
        f = np.array([np.nan if v is None else v for v in r.flux])
        g = np.where(np.isnan(f), 0, g)
        num, den, var, tot = num + np.nan_to_num(f) * g, den + g * g, var + g * 0.25, tot + g
    return num / den, np.sqrt(var / den), tot


def test_sources_by_shot(spark):
    df = fibers(spark)
    where = [(1, 150.0, 0.0), (2, 150 + 3 / 3600, -2 / 3600), (3, 151.0, 0.0)]
    out = extraction.extract_sources(df, spark.createDataFrame(where, "source int, ra double, dec double"), ["shot"], "source", "fiber", "flux", "error", "seeing", 5.0, PROFILE, F.lit(20.0), least=0.01)
    got, rows = out.collect(), df.collect()
    assert {(r.shot, r.source) for r in got} == {(s, k) for s in ("s1", "s2") for k in (1, 2)} and len(got) == 32
    for r in got:
        f, e, w = by_hand([x for x in rows if x.shot == r.shot], *where[r.source - 1][1:], 5.0)
        assert (r.flux, r.error, r.weight) == pytest.approx((f[r.idx], e[r.idx], w[r.idx]))


def test_sources_of_one_place_are_extracted_once(spark, monkeypatch):
    df, pairs, summed = fibers(spark), [], extraction._summed
    monkeypatch.setattr(extraction, "_summed", lambda rows, *a: pairs.append(rows.count()) or summed(rows, *a))
    extract = lambda where: {
        (r.shot, r.source, r.idx): (r.flux, r.error, r.weight)
        for r in extraction.extract_sources(
            df, spark.createDataFrame(where, "source int, ra double, dec double"), ["shot"], "source", "fiber", "flux", "error", "seeing", 5.0, PROFILE, F.lit(20.0), least=0.01
        ).collect()
    }
    a, b = (150.0, 0.0), (150 + 3 / 3600, -2 / 3600)
    # 4 stands at both places, which are summed; a source without a number is one of its own
    one = extract([(1, *a), (2, *b), (4, *a), (4, *b)])
    many = extract([(k, *a) for k in (1, 11, 12, 13, None)] + [(2, *b), (21, *b), (4, *a), (4, *b), (44, *b), (44, *a), (5, None, 0.0)])
    assert pairs[1] == pairs[0]
    of = {None: 1, 11: 1, 12: 1, 13: 1, 21: 2, 44: 4}
    assert {k[1] for k in many} == {None, 1, 2, 4, 11, 12, 13, 21, 44} and len(many) == 9 * 2 * 8
    for (shot, source, i), v in many.items():
        assert v == pytest.approx(one[shot, of.get(source, source), i])


def test_normalised_spectra_meet_counted_tables(spark, monkeypatch):
    named, few = [], extraction.few
    monkeypatch.setattr(extraction, "few", lambda df: named.append(df.columns) or few(df, 1))  # the larger ones by a shuffle
    spectra = spark.createDataFrame([("s", k, i, 1.0 + k, 0.5) for k in range(3) for i in range(4)], "shot string, source int, idx int, flux double, error double")
    response, curve = (spark.createDataFrame([(i, v) for i in range(4)], f"idx int, {c} double") for c, v in (("response", 0.25), ("factor", 2.0)))
    catalog = spark.createDataFrame([(0, 20.0), (1, 21.0)], "source int, g double")
    out = extraction.normalised(spectra, ["shot", "source"], "idx", response, catalog, "g", curve).collect()
    assert named == [["idx", "__c"], ["idx", "response"], ["shot", "source", "normalisation"]] and len(out) == 12
    for r in out:
        want = 10 ** (-0.4 * (20 + r.source - 23.9)) if r.source < 2 else 2 * (1 + r.source)
        assert r.flux == pytest.approx(want) and r.flux / r.error == pytest.approx(2 * (1 + r.source))


def test_tiles_join_to_one_grid(spark):
    df = fibers(spark)
    at = lambda rows: spark.createDataFrame(rows, "tile int, ra double, dec double")
    cube = lambda tiles, half: extraction.tile_cube(df, tiles, "tile", "shot", half, 1.0, "fiber", "flux", "error", "seeing", 5.0, PROFILE, F.lit(20.0), 0.01)
    # tiles of 3 x 3 cells whose middles are 3 cells apart cover one of 9 x 3; on the equator cells are square
    whole = {(r.cx, r.cy, r.idx): (r.flux, r.error) for r in cube(at([(0, 150.0, 0.0)]), 4).collect()}
    parts = cube(at([(t, 150 + 3 * t / 3600, 0.0) for t in (-1, 0, 1)]), 1).collect()
    assert len(parts) == 3 * 9 * 8
    for r in parts:
        assert (r.flux, r.error) == pytest.approx(whole[r.cx + 3 * r.tile, r.cy, r.idx], rel=1e-6)
