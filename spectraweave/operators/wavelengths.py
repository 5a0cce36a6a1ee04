"""From arc spectra to wavelengths: which peak is which line, and a wavelength for every pixel of every fiber."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fits import evaluate, linear_fit, poly_fit, powers
from .lineage import cut, few
from .robust import median
from .windows import local_peaks, suppress_close, top_n

#: Dispersion that stands in for a flat or unknown one, and the slope under which a model is flat.
_USUAL, _FLAT = 1.95, 1e-6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moment(u: Column, power: int, y: Column | None = None) -> Column:
    """The sum of u ** power, times y, over arrays."""
    term = lambda v: F.pow(v, F.lit(float(power)))
    return _sum(F.transform(u, term) if y is None else F.zip_with(u, y, lambda v, w: term(v) * w))


def quadratic(u: Column, y: Column) -> Column:
    """The coefficients of the quadratic through arrays u and y, in closed form; NULL where it isn't determined."""
    names = ["n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"]
    sums = [F.size(u).cast("double"), *[_moment(u, k) for k in range(1, 5)], *[_moment(u, k, y) for k in range(3)]]

    def solved(m: Column) -> Column:
        n, s1, s2, s3, s4, t0, t1, t2 = (m[c] for c in names)
        a, b, c = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
        d, e, f = n * s4 - s2 * s2, s1 * s2 - n * s3, n * s2 - s1 * s1
        det = n * a + s1 * b + s2 * c
        return F.array(*[F.try_divide(r, det) for r in (a * t0 + b * t1 + c * t2, b * t0 + d * t1 + e * t2, c * t0 + e * t1 + f * t2)])

    return _once(F.struct(*[v.alias(k) for k, v in zip(names, sums)]), solved)


def anchor_fits(peaks: DataFrame, keys: Sequence[str], x: str, height: str, lines: Sequence[float], brightest: int = 6) -> DataFrame:
    """(keys, subset, mid, half, coef, rms) for each ordered subset of as many lines as the brightest peaks.

    Each subset is taken for the brightest peaks in their order, a quadratic is
    fitted through it, and rms is that of its values at the peaks to the nearest
    line of all. Keys with fewer peaks have no rows. The subsets, of which there
    are binomially many, are a table made from the lines alone.
    """
    known = sorted(map(float, lines))
    subsets = [[known[k] for k in s] for s in itertools.combinations(range(len(known)), brightest)]
    bright = top_n(peaks, keys, brightest, F.desc(height), x)
    packed = bright.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col(x).cast("double"))).alias("__x")).where(F.size("__x") == brightest)
    ends = F.element_at("__x", 1), F.element_at("__x", -1)
    packed = packed.withColumn("mid", (ends[0] + ends[1]) / 2).withColumn("half", F.greatest((ends[1] - ends[0]) / 2, F.lit(1e-9)))
    packed = packed.withColumn("__u", F.transform("__x", lambda v: (v - F.col("mid")) / F.col("half")))
    every = F.array(*[F.array(*map(F.lit, s)) for s in subsets])
    tried = packed.select(*keys, "mid", "half", "__u", F.posexplode(every).alias("subset", "__y"))
    near = F.array(*map(F.lit, known))

    def judged(coef: Column) -> Column:
        at = F.transform("__u", lambda u: F.get(coef, F.lit(0)) + F.get(coef, F.lit(1)) * u + F.get(coef, F.lit(2)) * u * u)
        squares = F.transform(at, lambda m: F.pow(F.array_min(F.transform(near, lambda w: F.abs(w - m))), F.lit(2.0)))
        return F.struct(coef.alias("coef"), F.sqrt(_sum(squares) / brightest).alias("rms"))

    return tried.withColumn("__f", _once(quadratic(F.col("__u"), F.col("__y")), judged)).select(*keys, "subset", "mid", "half", "__f.coef", "__f.rms")


def _terms(x: Column, degree: int) -> list[Column]:
    return powers((x - F.col("mid")) / F.col("half"), degree)


def model_matches(peaks: DataFrame, models: DataFrame, keys: Sequence[str], x: str, lines: Sequence[float], degree: int, tolerance: float) -> DataFrame:
    """(keys, mid, half, line, x, residual): for each line the peak whose modelled wavelength is nearest, if that is within `tolerance` pixels.

    models: keys, mid, half and coef, a polynomial's coefficients in (x - mid) / half.
    A peak belongs to the first line that takes it.
    """
    terms = _terms(F.col(x), degree)
    slope = sum((F.get("coef", F.lit(k)) * k * terms[k - 1] for k in range(1, degree + 1)), F.lit(0.0)) / F.col("half")
    rows = peaks.select(*keys, x).join(models.select(*keys, "mid", "half", "coef").hint("shuffle_hash"), list(keys)).where("coef is not null")
    rows = rows.withColumn("__wave", evaluate(F.col("coef"), terms)).withColumn("__s", F.when(F.abs(slope) < _FLAT, _USUAL).otherwise(F.abs(slope)))
    rows = rows.withColumn("line", F.explode(F.array(*map(F.lit, sorted(map(float, lines)))))).withColumn("residual", F.col("__wave") - F.col("line"))
    nearest = top_n(rows, [*keys, "line"], 1, F.abs("residual"), x).where(F.abs("residual") / F.col("__s") <= tolerance)
    return top_n(nearest, [*keys, x], 1, "line").select(*keys, "mid", "half", "line", x, "residual")


def identify_arc(
    peaks: DataFrame, keys: Sequence[str], x: str, height: str, lines: Sequence[float], brightest: int = 6, separation: float = 10.0, most: int = 15,
    tolerance: float = 12.0, degree: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Solutions (keys, mid, half, coef, n_match, rms) and their matches (keys, line, x, residual).

    Peaks too close to a higher one go first. The best subset's quadratic finds
    matches, a polynomial of `degree` is fitted through them and finds them again:
    those give n_match and rms. Keys whose matches don't determine the polynomial
    have no solution.
    """
    apart = cut(suppress_close(peaks, keys, x, height, separation, most))  # a few rows a key, read three times
    tried = anchor_fits(apart, keys, x, height, lines, brightest)
    best = tried.where("rms is not null").groupBy(*keys).agg(F.min(F.struct("rms", "subset", "mid", "half", "coef")).alias("b")).select(*keys, "b.mid", "b.half", "b.coef")
    first = model_matches(apart, best, keys, x, lines, 2, tolerance)
    fit = cut(linear_fit(first, [*keys, "mid", "half"], _terms(F.col(x), degree), F.col("line")).where("coef is not null").drop("n"))
    matches = model_matches(apart, fit, keys, x, lines, degree, tolerance)
    found = matches.groupBy(*keys).agg(F.count("*").alias("n_match"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms"))
    return fit.join(found.hint("shuffle_hash"), list(keys)).select(*keys, "mid", "half", "coef", "n_match", "rms"), matches.select(*keys, "line", x, "residual")


def seed_spectra(arcs: DataFrame, keys: Sequence[str], flux: str, every: int = 8, first: int = 2, around: int = 2) -> DataFrame:
    """(keys, fiber, col, flux) of the seeds: the median of the fibers around them.

    Seeds are every so many fibers, from `first` on, and the third from the end. A
    fiber is copied to the seeds that it is near to, of which there are few.
    """
    size = arcs.groupBy(*keys).agg(F.max("fiber").alias("__last"))
    near = F.array(*[F.col("fiber") + d for d in range(-around, around + 1)])
    is_seed = lambda s: (s >= first) & (s <= F.col("__last")) & ((F.pmod(s - first, F.lit(every)) == 0) | (s == F.greatest(F.col("__last") - first, F.lit(0))))
    dealt = arcs.join(few(size), list(keys)).withColumn("__seed", F.explode(F.array_distinct(F.filter(near, is_seed))))
    return dealt.groupBy(*keys, F.col("__seed").alias("fiber"), "col").agg(median(F.col(flux)).alias(flux))


def wavelength_map(
    arcs: DataFrame, traces: DataFrame, keys: Sequence[str], flux: str, lines: Sequence[float], every: int = 8, columns: int = 24, limit: float = 1.0, least: int = 7,
    degree: int = 4, threshold: float = 1.0, brightest: int = 6, separation: float = 10.0, most: int = 15, tolerance: float = 12.0,
) -> DataFrame:
    """(keys, fiber, col, wave): a wavelength for every pixel of every fiber of an amplifier.

    arcs: keys, fiber, col, flux; traces: keys, fiber, col, trace. Seeds' solutions
    with an rms under the limit are read at every so many columns; across the
    fibers they are joined by a polynomial in the trace, and along each fiber by one
    in the column. An amplifier with fewer than `least` good seeds has no rows.
    """
    seeds = seed_spectra(arcs, keys, flux, every)
    peaks = local_peaks(seeds, [*keys, "fiber"], "col", flux, threshold).select(*keys, "fiber", "peak", flux)
    found, _ = identify_arc(peaks, [*keys, "fiber"], "peak", flux, lines, brightest, separation, most, tolerance, degree)
    good = found.where((F.col("rms") > 0) & (F.col("rms") < limit)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least)
    last = few(traces.groupBy(*keys).agg(F.max("col").alias("__last")))
    grid = traces.join(last, list(keys)).where((F.col("col") % columns == 0) | (F.col("col") == F.col("__last"))).select(*keys, "fiber", "col", "trace")
    seen = grid.join(good.select(*keys, "fiber", "mid", "half", "coef"), [*keys, "fiber"], "left")
    seen = seen.withColumn("__wave", evaluate(F.col("coef"), _terms(F.col("col"), degree))).select(*keys, "fiber", "col", "trace", "__wave")
    across = poly_fit(cut(seen), [*keys, "col"], "trace", "__wave", degree, out="__across").where("__across > 0")
    place = 2 * F.col("col") / F.greatest(F.col("n_last"), F.lit(1)) - 1
    along = linear_fit(across.join(last.withColumnRenamed("__last", "n_last"), list(keys)), [*keys, "fiber", "n_last"], powers(place, degree), F.col("__across")).where("coef is not null")
    rows = traces.select(*keys, "fiber", "col").join(few(along), [*keys, "fiber"])
    return rows.select(*keys, "fiber", "col", evaluate(F.col("coef"), powers(place, degree)).alias("wave"))
