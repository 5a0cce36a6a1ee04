"""Models of what lies under and over the spectra: scattered light, levels of amplifiers, fiber profiles, surfaces, gaps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .arrays import continuum
from .fits import poly_fit
from .lineage import cut
from .robust import median
from .traces import even_chunk, gaussian_kernel
from .windows import ordered, running_median_2d


def gap_samples(
    frame: DataFrame, trace: DataFrame, keys: Sequence[str], value: str, at: int, wide: float = 10.0, clear: int = 7, edge: int = 4, chunks: int = 25
) -> DataFrame:
    """(keys, gap, chunk, x, y, value): the median light between the fibers, by gap and chunk of columns, with its mean place.

    A gap lies above a fiber whose next one is more than `wide` rows off in column
    `at`, and below the first and above the last fiber; rows within `clear` of a
    trace, or within `edge` of the frame's ends, don't count.
    """
    size = frame.groupBy(*keys).agg((F.max("row") + 1).alias("__rows"), (F.max("col") + 1).alias("__cols"))
    up = ordered([*keys, "col"], "fiber")
    rows = trace.withColumn("__next", F.lead("trace").over(up)).withColumn("__first", F.row_number().over(up) == 1).join(size, list(keys))
    here = F.max(F.when(F.col("col") == at, F.col("__next") - F.col("trace"))).over(Window.partitionBy(*keys, "fiber"))
    rows = rows.withColumn("__wide", here > wide)
    from_, to = F.ceil("trace") + clear, F.when(F.col("__next").isNull(), F.col("__rows") - edge).otherwise(F.ceil("__next") - clear)
    above = rows.where("__next is null or __wide").select(*keys, "col", F.col("fiber").cast("long").alias("gap"), from_.alias("a"), to.alias("b"), "__cols")
    below = rows.where("__first").select(*keys, "col", (F.col("fiber") - 1).cast("long").alias("gap"), F.lit(edge).cast("long").alias("a"), (F.ceil("trace") - clear).alias("b"), "__cols")
    spans = above.unionByName(below).where("b > a").withColumn("row", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    met = spans.withColumn("chunk", even_chunk(F.col("col"), F.col("__cols"), chunks)).join(frame.select(*keys, F.col("row").cast("long").alias("row"), "col", value), [*keys, "row", "col"])
    return met.groupBy(*keys, "gap", "chunk").agg(F.avg("col").alias("x"), F.avg("row").alias("y"), median(F.col(value)).alias(value))


def lattice(samples: DataFrame, keys: Sequence[str], value: str, size: DataFrame, n: int = 25, sigma: float = 150.0) -> DataFrame:
    """(keys, gx, gy, value): the samples' Gaussian-weighted mean at each node of an n x n lattice over the frame; size(keys, rows, cols).

    Every sample of a frame counts at every node; both are few.
    """
    nodes = F.explode(F.array(*[F.struct(F.lit(a).alias("gx"), F.lit(b).alias("gy")) for a in range(n) for b in range(n)]))
    rows = samples.where(F.col(value).isNotNull()).join(size, list(keys)).select(*keys, "x", "y", value, "rows", "cols", nodes.alias("g"))
    dx, dy = F.col("x") - F.col("g.gx") * (F.col("cols") - 1) / (n - 1), F.col("y") - F.col("g.gy") * (F.col("rows") - 1) / (n - 1)
    w = F.exp(-0.5 * (dx * dx + dy * dy) / sigma**2)
    return rows.groupBy(*keys, F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias(value))


def from_lattice(pixels: DataFrame, nodes: DataFrame, keys: Sequence[str], value: str, size: DataFrame, n: int = 25, out: str = "scattered") -> DataFrame:
    """Adds the lattice's bilinear value at each pixel (keys, row, col)."""
    rows = pixels.join(size, list(keys))
    fx, fy = F.col("col") * (n - 1) / F.greatest(F.col("cols") - 1, F.lit(1)), F.col("row") * (n - 1) / F.greatest(F.col("rows") - 1, F.lit(1))
    rows = rows.withColumn("gx", F.least(F.floor(fx), F.lit(n - 2)).cast("int")).withColumn("gy", F.least(F.floor(fy), F.lit(n - 2)).cast("int")).withColumn("__fx", fx).withColumn("__fy", fy)
    # four corners in one row, by the lower of each direction
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = nodes.withColumn("s", corner).withColumn("gx", F.col("gx") - F.col("s.a")).withColumn("gy", F.col("gy") - F.col("s.b"))
    pick = lambda a, b: F.max(F.when((F.col("s.a") == a) & (F.col("s.b") == b), F.col(value))).alias(f"__v{a}{b}")
    corners = spread.groupBy(*keys, "gx", "gy").agg(*[pick(a, b) for a in (0, 1) for b in (0, 1)])
    met = rows.join(corners, [*keys, "gx", "gy"], "left")
    u, v = F.col("__fx") - F.col("gx"), F.col("__fy") - F.col("gy")
    at = F.col("__v00") * (1 - u) * (1 - v) + F.col("__v10") * u * (1 - v) + F.col("__v01") * (1 - u) * v + F.col("__v11") * u * v
    return met.withColumn(out, at).select(*pixels.columns, out)


def scattered_light(frame: DataFrame, trace: DataFrame, keys: Sequence[str], value: str, at: int, n: int = 25, sigma: float = 150.0, wide: float = 10.0, clear: int = 7, edge: int = 4, chunks: int = 25) -> DataFrame:
    """Adds scattered: the smooth light under the fibers, from the gaps between them; NULL for a frame without gaps."""
    size = frame.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    samples = gap_samples(frame, trace, keys, value, at, wide, clear, edge, chunks)
    return from_lattice(frame, lattice(samples, keys, value, size, n, sigma), keys, value, size, n)


def penalised_levels(
    spectra: DataFrame, keys: Sequence[str], amp: str, fiber: str, i: str, flux: str, chunks: int = 12, rounds: int = 3, width: int = 11, steps: int = 10, step: float = 0.005
) -> DataFrame:
    """(keys, chunk, amp, fiber, ratio): each fiber's level in each chunk of bins, to the median of all.

    A level is one of 2 steps + 1 about the median that is near both to the fiber's
    own median and to its amplifier's level so far, by the sum of squares; after the
    rounds a moving mean of `width` fibers smooths each amplifier.
    """
    whole = spectra.groupBy(*keys).agg((F.max(i) + 1).alias("__n"))
    rows = spectra.join(whole, list(keys)).withColumn("chunk", even_chunk(F.col(i), F.col("__n"), chunks)).where(F.col(flux).isNotNull() & (F.col(flux) != 0))
    middle = rows.groupBy(*keys, "chunk").agg(median(F.col(flux)).alias("__mid"))
    now = rows.groupBy(*keys, "chunk", amp, fiber).agg(median(F.col(flux)).alias("__x")).join(middle, [*keys, "chunk"]).withColumn("__y", F.col("__mid"))
    group = Window.partitionBy(*keys, "chunk", amp)
    for _ in range(rounds):
        now = now.withColumn("__a", median(F.col("__y")).over(group))
        # the best of the steps is the one next to the mean of both, within the ends; of two the lower
        at = F.try_divide((F.col("__x") + F.col("__a")) / 2, "__mid") - 1
        now = now.withColumn("__y", F.col("__mid") * (1 + step * F.least(F.greatest(F.ceil(F.round(at / step, 9) - 0.5), F.lit(-steps)), F.lit(steps))))
    smooth = F.avg("__y").over(group.orderBy(fiber).rowsBetween(-(width // 2), width // 2))
    return now.withColumn("ratio", F.try_divide(smooth, "__mid")).select(*keys, "chunk", amp, fiber, "ratio")


def gradient(df: DataFrame, keys: Sequence[str], i: str, y: str, out: str = "gradient") -> DataFrame:
    """Adds the mean of the steps to both neighbours, in size; at the ends that of the place next to them."""
    w = ordered(keys, i)
    both = (F.abs(F.col(y) - F.lag(y).over(w)) + F.abs(F.lead(y).over(w) - F.col(y))) / 2
    rows = df.withColumn("__step", both)
    return rows.withColumn(out, F.when(F.lag(i).over(w).isNull(), F.lead("__step").over(w)).when(F.lead(i).over(w).isNull(), F.lag("__step").over(w)).otherwise(F.col("__step"))).drop("__step")


def smooth_grid(grid: DataFrame, keys: Sequence[str], row: str, col: str, value: str, sigma: float, out: str = "smoothed") -> DataFrame:
    """Adds the Gaussian mean of the cells present about each cell of a whole grid, in two passes of one direction each."""
    kernel = gaussian_kernel(sigma)
    half = len(kernel) // 2
    now = grid.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(0.0))).withColumn("__w", F.col(value).isNotNull().cast("double"))
    for along, across in ((col, row), (row, col)):
        w = ordered([*keys, across], along)
        for c in ("__v", "__w"):
            terms = [F.coalesce(F.lag(c, half - j).over(w) if j < half else F.lead(c, j - half).over(w) if j > half else F.col(c), F.lit(0.0)) * k for j, k in enumerate(kernel)]
            now = now.withColumn(f"{c}2", sum(terms[1:], terms[0]))
        now = now.drop("__v", "__w").withColumnRenamed("__v2", "__v").withColumnRenamed("__w2", "__w")
    return now.withColumn(out, F.try_divide("__v", "__w")).drop("__v", "__w")


def readout_gaps(grid: DataFrame, keys: Sequence[str], row: str, col: str, value: str, share: float = 1 / 3, out: str = "kept") -> DataFrame:
    """Adds the value, NULL onward from the first missing row from which on more than a share of a column is missing.

    Rows are those of a frame from 0 on, counted from the readout side. What lies
    behind a defect was read through it. The last two rows begin no gap.
    """
    # counted from the end: a frame that runs to the last row would be gone through again for every row
    ahead = ordered([*keys, col], F.desc(row)).rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy(*keys, col)
    missing = F.count(F.when(F.col(value).isNull(), 1)).over(ahead)
    rest = F.max(row).over(column) + 1 - F.col(row)
    rows = grid.withColumn("__from", F.when(F.col(value).isNull() & (missing > rest * share) & (rest > 2), F.col(row)))
    return rows.withColumn("__start", F.min("__from").over(column)).withColumn(out, F.when(F.col("__start").isNull() | (F.col(row) < F.col("__start")), F.col(value))).drop("__from", "__start")


def flat_residual(
    spectra: DataFrame, keys: Sequence[str], fiber: str, i: str, flux: str, error: str, sky: str, limit: float = 0.5, sigma: float = 7.0, out: str = "residual"
) -> DataFrame:
    """Adds the flat-corrected residual over its error and the sky's gradient; what is beyond the limit, and behind long gaps, is NULL.

    flux is what is left of a fiber after its sky, sky that sky itself.
    """
    rows = gradient(spectra, [*keys, fiber], i, sky, "__g")
    r = F.try_divide(F.col(flux), F.sqrt(F.pow(error, 2) + F.pow("__g", 2)))
    rows = rows.withColumn("__r", r).withColumn("__r", F.when(F.abs("__r") <= limit, F.col("__r")))
    rows = smooth_grid(rows, keys, fiber, i, "__r", sigma, "__s").withColumn("__r", F.col("__r") - F.col("__s"))
    return readout_gaps(rows, keys, fiber, i, "__r", out=out).select(*spectra.columns, out)


def stacked_profile(samples: DataFrame, keys: Sequence[str], offset: str, value: str, chunks: int = 25) -> DataFrame:
    """(keys, chunk, x, y): the light across a fiber, from the samples of many fibers put in order of their distance to their trace.

    The samples of a key, at offsets of parts of a pixel, are cut into equal counts
    whose medians are the profile.
    """
    parts = samples.where(F.col(offset).isNotNull() & F.col(value).isNotNull()).withColumn("chunk", F.ntile(chunks).over(Window.partitionBy(*keys).orderBy(offset, value)) - 1)
    return parts.groupBy(*keys, "chunk").agg(median(F.col(offset)).alias("x"), median(F.col(value)).alias("y"))


def profile_samples(frame: DataFrame, trace: DataFrame, spectra: DataFrame, keys: Sequence[str], value: str, flux: str, reach: float = 6.0) -> DataFrame:
    """(keys, fiber, col, offset, share): the pixels within reach of each trace, over the fiber's own flux there."""
    # a trace meets the pixels of its stretches of rows: one or two copies of it, where one for each pixel would be a dozen
    stretch = max(1, math.ceil(4 * reach))
    lit = trace.join(spectra.select(*keys, "fiber", "col", F.col(flux).alias("__flux")), [*keys, "fiber", "col"])
    lit = lit.withColumn("__low", F.ceil(F.col("trace") - reach)).withColumn("__high", F.floor(F.col("trace") + reach))
    near = lit.withColumn("__part", F.explode(F.sequence(F.floor(F.col("__low") / stretch), F.floor(F.col("__high") / stretch))))
    pixels = frame.select(*keys, F.col("row").cast("long").alias("row"), "col", F.col(value).alias("__value")).withColumn("__part", F.floor(F.col("row") / stretch))
    met = near.join(pixels, [*keys, "col", "__part"]).where(F.col("row").between(F.col("__low"), F.col("__high")))
    return met.select(*keys, "fiber", "col", (F.col("row") - F.col("trace")).alias("offset"), F.try_divide("__value", "__flux").alias("share"))


def column_surface(points: DataFrame, pixels: DataFrame, keys: Sequence[str], at: str, value: str, degree: int = 7, out: str = "surface") -> DataFrame:
    """pixels (keys, row, col) with the value of a polynomial in the row, fitted column by column to points (keys, col, at, value).

    A column with fewer points than coefficients has NULL.
    """
    own = points.select(*keys, "col", F.col(at).cast("double").alias("__x"), F.col(value).cast("double").alias("__y"), F.lit(False).alias("__pixel"))
    asked = pixels.select(*keys, "col", F.col("row").cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(True).alias("__pixel"))
    return poly_fit(own.unionByName(asked), [*keys, "col"], "__x", "__y", degree, out=out).where("__pixel").select(*keys, F.col("__x").cast("long").alias("row"), "col", out)


def read_curve(df: DataFrame, curve: DataFrame, keys: Sequence[str], at: str, x: str, y: str, first: float, step: float, out: str) -> DataFrame:
    """Adds the curve's (keys, x, y) linear value at `at`; its knots are an even grid from first on. NULL outside."""
    knots = curve.select(*keys, F.round((F.col(x) - first) / step).cast("long").alias("__k"), F.col(y).alias("__v"))
    pairs = knots.withColumn("__w", F.lead("__v").over(ordered(keys, "__k")))
    place = (F.col(at) - first) / step
    met = df.withColumn("__k", F.floor(place)).withColumn("__p", place).join(pairs, [*keys, "__k"], "left")
    share = F.col("__p") - F.col("__k")
    return met.withColumn(out, F.when(share == 0, F.col("__v")).otherwise(F.col("__v") + (F.col("__w") - F.col("__v")) * share)).select(*df.columns, out)


def model_image(waves: DataFrame, fibers: DataFrame, spectrum: DataFrame, levels: DataFrame, keys: Sequence[str], grid: tuple[float, float], rows: tuple[float, float]) -> DataFrame:
    """(keys, row, col, model): the mean spectrum at each pixel's wavelength, times the fibers' level at its place across them.

    waves(keys, row, col, surface) and fibers(keys, row, col, surface) are column
    surfaces; spectrum(keys, wave, flux) and levels(keys, at, level) are curves on
    even grids, given by their first knot and their step.
    """
    light = read_curve(waves.withColumnRenamed("surface", "__wave"), spectrum, keys, "__wave", "wave", "flux", *grid, "__light")
    level = read_curve(fibers.withColumnRenamed("surface", "__at"), levels, keys, "__at", "at", "level", *rows, "__level")
    both = light.join(level.select(*keys, "row", "col", "__level"), [*keys, "row", "col"])
    return both.select(*keys, "row", "col", (F.col("__light") * F.col("__level")).alias("model"))


def nearest_filled(grid: DataFrame, keys: Sequence[str], row: str, col: str, value: str, missing: Column | None = None, out: str = "filled") -> DataFrame:
    """Adds the value, and for a missing cell that of the nearest cell that has one (ties: the smaller row, then column).

    Each row gives its nearest valid cell to either side of every column; a hole
    looks among those of the rows close to it, and of ever more rows only while
    what it found may not be the nearest. A frame without values stays NULL.
    """
    gone = F.col(value).isNull() if missing is None else missing | F.col(value).isNull()
    seen = F.when(~gone, F.struct(F.col(col).alias("c"), F.col(value).alias("v")))
    w = ordered([*keys, row], col)
    rows = grid.withColumn("__gone", gone).withColumn("__s", seen)
    rows = rows.withColumn("__l", F.last("__s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.first("__s", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = cut(rows.drop("__s"))
    ends = F.filter(F.array("__l", "__r"), lambda s: s.isNotNull())
    seen_from = rows.select(*keys, F.col(row).alias("__row"), col, ends.alias("__ends")).where(F.size("__ends") > 0)
    frames = rows.where("not __gone").select(*keys).distinct()
    todo = cut(rows.where("__gone").select(*keys, row, col).join(frames, list(keys), "left_semi"))
    height = rows.agg(F.max(row) - F.min(row)).first()[0] or 0
    reach, filled = 4, None
    while True:
        band = F.floor(F.col(row) / reach)
        holes = todo.withColumn("__band", F.explode(F.array(band - 1, band, band + 1)))
        near = seen_from.withColumn("__band", F.floor(F.col("__row") / reach))
        met = holes.join(near, [*keys, col, "__band"])
        best = F.array_min(F.transform("__ends", lambda s: F.struct((F.pow(F.col("__row") - F.col(row), 2) + F.pow(s["c"] - F.col(col), 2)).alias("d"), F.col("__row").alias("r"), s["c"].alias("c"), s["v"].alias("v"))))
        found = met.groupBy(*keys, row, col).agg(F.min(best).alias("__n"))
        tried = cut(todo.join(found, [*keys, row, col], "left"))
        # rows that weren't looked at are farther off than the reach
        sure = F.coalesce(F.col("__n.d") <= reach * reach, F.lit(False)) if reach <= height else F.lit(True)
        hit = tried.where(sure).select(*keys, row, col, F.col("__n.v").alias("__fill"))
        filled = hit if filled is None else filled.unionByName(hit)
        todo = tried.where(~sure).drop("__n")
        if reach > height or todo.isEmpty():
            break
        reach *= 2
    met = rows.join(filled, [*keys, row, col], "left")
    return met.withColumn(out, F.when(F.col("__gone"), F.col("__fill")).otherwise(F.col(value))).select(*grid.columns, out)


def component_model(grid: DataFrame, keys: Sequence[str], row: str, col: str, value: str, target: str, k: int = 4, out: str = "model") -> DataFrame:
    """Adds the projection of each row of `target` on the k principal components of `value` over an amplifier's rows.

    Missing values count as 0 for the components, missing targets as 0 for the
    projection; a component is a curve over the columns. An amplifier is one group:
    as many cells as it has fibers and bins, whatever the size of the survey.
    """
    schema = StructType([*grid.schema.fields, StructField(out, DoubleType())])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame[row].rank(method="dense").astype(int) - 1, frame[col].rank(method="dense").astype(int) - 1
        y, z = np.zeros((r.max() + 1, c.max() + 1)), np.zeros((r.max() + 1, c.max() + 1))
        y[r, c], z[r, c] = np.nan_to_num(frame[value].to_numpy(float)), np.nan_to_num(frame[target].to_numpy(float))
        u, s, _ = np.linalg.svd(y.T - y.T.mean(axis=0), full_matrices=False)
        n = min(k, int((s > 1e-12 * max(s.max(initial=0), 1e-300)).sum()))
        curves = u[:, :n]
        return frame.assign(**{out: ((z @ curves) @ curves.T)[r, c]})

    return grid.groupBy(*keys).applyInPandas(solve, schema)


def amp_residual(
    spectra: DataFrame, keys: Sequence[str], fiber: str, i: str, flux: str, error: str, masked: Column, half: tuple[int, int] = (2, 25), k: int = 4, bins: int = 25, out: str = "residual"
) -> DataFrame:
    """Adds what an amplifier leaves in its spectra: the running median of the residuals over their errors, and a few components of what that leaves.

    flux is the spectrum without its sky. Masked and missing bins take the nearest
    valid one's value before the median, and no part in the components; the result
    is NULL where the flux is. The components are fitted to spectra without their
    continuum.
    """
    rows = spectra.withColumn("__y", F.try_divide(flux, error))
    rows = nearest_filled(rows, keys, fiber, i, "__y", masked | (F.col("__y") == 0), "__full")
    rows = running_median_2d(rows, keys, fiber, i, "__full", *half, out="__back")
    valid = F.col("__y").isNotNull() & ~F.coalesce(masked, F.lit(False)) & (F.col("__y") != 0)
    rows = rows.withColumn("__left", F.when(valid, F.col("__y") - F.col("__back"))).withColumn("__all", F.col("__y") - F.col("__back"))
    rows = continuum(rows, [*keys, fiber], i, "__all", bins, "__level").withColumn("__target", F.col("__all") - F.col("__level"))
    rows = component_model(rows, keys, fiber, i, "__left", "__target", k, "__model")
    found = F.when(F.col("__y").isNotNull(), (F.col("__model") + F.col("__back")) * F.col(error))
    return rows.withColumn(out, found).select(*spectra.columns, out)
