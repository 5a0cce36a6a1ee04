"""Source extraction: profile weights, extracted spectra, signal-to-noise cubes, line fits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.scalar import seeing_at
from ..functions.sky import REFRACTION_SHIFTS, REFRACTION_WAVES, refracted, refraction, refraction_offset, to_plane
from .arrays import continuum, rectify
from .calibrate import coadd
from .fits import evaluate, linear_fit, powers
from .grid import median_mosaic, splat
from .joins import within_radius
from .lineage import FEW, cut, dealt, few
from .robust import biweight, mad_std, median
from .windows import dilate, smooth

#: Radius of a fiber in arcseconds.
FIBER_RADIUS = 0.75
_RINGS = 4


def aperture_points(radius: float = FIBER_RADIUS, rings: int = _RINGS) -> list[tuple[float, float]]:
    """Points that sample a disk evenly: the centers of the cells of a square grid that lie inside."""
    step = radius / rings
    at = [(k + 0.5) * step for k in range(-rings, rings)]
    return [(x, y) for x in at for y in at if x * x + y * y <= radius * radius]


def moffat(r2: Column, fwhm: Column, beta: float) -> Column:
    """A Moffat profile of unit flux at a squared distance."""
    alpha2 = fwhm * fwhm / (4 * (2 ** (1 / beta) - 1))
    return (beta - 1) / (math.pi * alpha2) * F.pow(1 + r2 / alpha2, -beta)


def aperture_table(cells: DataFrame, widths: Sequence[float], beta: float, cell: float, radius: float = FIBER_RADIUS) -> DataFrame:
    """(width number, cell, value): the share of a point source's light in a fiber, by seeing and distance.

    cells: ids of distances in steps of `cell`. The profile is integrated over
    the fiber's aperture.
    """
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in aperture_points(radius)])
    size = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("fwhm")) for n, w in enumerate(widths)])
    rows = cells.select(F.col("id").alias("cell"), F.explode(size).alias("w")).select("cell", "w", F.explode(points).alias("p"))
    r2 = F.pow(F.col("cell") * cell + F.col("p.x"), 2) + F.pow("p.y", 2)
    return rows.groupBy("cell", F.col("w.n").alias("width")).agg((F.avg(moffat(r2, F.col("w.fwhm"), beta)) * math.pi * radius**2).alias("value"))


def fiber_weights(
    samples: DataFrame, table: DataFrame, dx: str, dy: str, wave: str, seeing: str, angle: Column, cell: float, first: float, step: float, n_widths: int
) -> DataFrame:
    """Adds weight: what part of a source's light at a wavelength falls in a fiber at (dx, dy) from it.

    The source is moved by refraction along the position angle; the seeing grows
    to the blue. `table` is aperture_table's, of widths first, first + step, ..;
    between its entries weights are interpolated in both directions. Beyond its
    widths the last ones hold, beyond its distances the weight is 0.
    """
    ax, ay = refraction_offset(refraction(F.col(wave)), angle)
    r = F.sqrt(F.pow(F.col(dx) - ax, 2) + F.pow(F.col(dy) - ay, 2)) / cell
    w = F.least(F.greatest((seeing_at(F.col(seeing), F.col(wave)) - first) / step, F.lit(0.0)), F.lit(n_widths - 1.0))
    rows = samples.withColumn("__r", r).withColumn("__w", w).withColumn("__c", F.floor("__r")).withColumn("__n", F.least(F.floor("__w"), F.lit(max(0, n_widths - 2))))
    # the table holds what a lookup needs: four neighbours in one row
    side = lambda a, b: table.select((F.col("cell") - a).alias("__c"), (F.col("width") - b).alias("__n"), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), "value").alias("v"))
    every = side(0, 0).unionByName(side(1, 0)).unionByName(side(0, 1)).unionByName(side(1, 1))
    pick = lambda a, b: F.max(F.when((F.col("v.a") == a) & (F.col("v.b") == b), F.col("v.value")))
    corners = every.groupBy("__c", "__n").agg(*[F.coalesce(pick(a, b), F.lit(0.0) if a else pick(0, b)).alias(f"__v{a}{b}") for a in (0, 1) for b in (0, 1)])
    met = rows.join(few(corners), ["__c", "__n"], "left")
    fr, fw = F.col("__r") - F.col("__c"), F.col("__w") - F.col("__n")
    low = F.col("__v00") * (1 - fr) + F.col("__v10") * fr
    high = F.coalesce(F.col("__v01") * (1 - fr) + F.col("__v11") * fr, low)
    return met.withColumn("weight", F.coalesce(low * (1 - fw) + high * fw, F.lit(0.0))).select(*samples.columns, "weight")


def aperture_grid(n_cells: int, widths: Sequence[float], beta: float, cell: float, radius: float = FIBER_RADIUS) -> np.ndarray:
    """aperture_table as an array of widths by cells."""
    x, y = np.array(aperture_points(radius)).T
    r2 = (np.arange(n_cells)[:, None] * cell + x) ** 2 + y**2
    alpha2 = np.array(widths, float)[:, None] ** 2 / (4 * (2 ** (1 / beta) - 1))
    return np.array([((beta - 1) / (math.pi * a) * (1 + r2 / a) ** -beta).mean(axis=1) * math.pi * radius**2 for a in alpha2])


class Profile:
    """A source's light in fibers: a grid of widths by cells, and the refraction that moves the source with the wavelength.

    widths are first, first + step, ..; between the grid's entries weights are
    interpolated in both directions. Beyond its widths the last ones hold, beyond
    its distances the weight is 0.
    """

    def __init__(self, grid: np.ndarray, waves: Sequence[float], cell: float, first: float, step: float):
        self.grid, self.cells = np.pad(grid, ((0, 1), (0, 2)))[:, :], grid.shape[1]
        self.grid[-1, : self.cells] = grid[-1]
        self.waves, self.cell, self.first, self.step, self.top = np.array(waves, float), cell, first, step, grid.shape[0] - 1
        knots = [(x - 4500.0) / 1000.0 for x in REFRACTION_WAVES]
        self.shift = np.polyval(np.polyfit(knots, REFRACTION_SHIFTS, 3), (self.waves - 4500.0) / 1000.0)
        self.blur = (self.waves / 4500.0) ** -0.2

    def weights(self, dx: np.ndarray, dy: np.ndarray, seeing: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """The weight of each pair of source and fiber (rows) at each wavelength."""
        turn = np.radians(angle)[:, None]
        r = np.hypot(dx[:, None] - self.shift * np.cos(turn), dy[:, None] - self.shift * np.sin(turn)) / self.cell
        w = np.clip((seeing[:, None] * self.blur - self.first) / self.step, 0, self.top)
        c, k = np.floor(r), np.minimum(np.floor(w), max(0, self.top - 1))
        fr, fw = r - c, w - k
        c, k = np.minimum(c, self.cells).astype(int), k.astype(int)
        g = self.grid
        return (g[k, c] * (1 - fr) + g[k, c + 1] * fr) * (1 - fw) + (g[k + 1, c] * (1 - fr) + g[k + 1, c + 1] * fr) * fw


_SUMS = ("__fg", "__gg", "__ge", "__g")


def _summed(pairs: DataFrame, by: Sequence[str], profile: Profile, flux: str, error: str, seeing: str) -> DataFrame:
    """(by, arrays of sums): each Arrow batch's weighted sums by source, over pairs that come sorted by it."""
    bins = len(profile.waves)
    fields = [pairs.schema[c] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            number = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
            spread = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, bins)
            f, e = spread(flux), spread(error)
            g = profile.weights(number("__dx"), number("__dy"), number(seeing), number("__angle"))
            ok = ~np.isnan(f)
            g = np.where(ok, g, 0.0)
            new = np.zeros(b.num_rows, bool)
            for c in by:
                v = b.column(c).to_pandas().to_numpy()
                new[1:] |= v[1:] != v[:-1]
            new[0] = True
            starts = np.flatnonzero(new)
            parts = (np.where(ok, f, 0.0) * g, g * g, g * np.nan_to_num(e) ** 2, g)
            lists = [pa.ListArray.from_arrays(np.arange(0, bins * len(starts) + 1, bins, dtype=np.int32), np.add.reduceat(x, starts).ravel()) for x in parts]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(starts)) for c in by], *lists], names=[*by, *_SUMS])

    sums = [StructField(c, ArrayType(DoubleType())) for c in _SUMS]
    return pairs.mapInArrow(run, StructType([*fields, *sums]))


def extract_sources(
    fibers: DataFrame, sources: DataFrame, keys: Sequence[str], source: str, fiber: str, flux: str, error: str, seeing: str, radius: float, profile: Profile, angle: Column,
    least: float = 0.05, most_masked: float = 0.5, i: str = "idx", parts: int = 4,
) -> DataFrame:
    """(keys, source, i, flux, error, weight): the spectrum of each source of a catalog in each shot (or exposure) that the keys name.

    fibers: keys, fiber, ra, dec and arrays of flux and error over the profile's
    wavelengths; sources: source, ra, dec. The seeing is a column of either, angle
    an expression over the fibers' columns. Sources that have a key among their
    columns meet only fibers of that key.

    Pairs within `radius` arcseconds carry ids and distances; the arrays join them
    once and are weighed and summed in Arrow batches, sorted by source, a source's
    pairs in `parts` tasks at most. Sources of one place (and seeing) have one
    spectrum, which is made once. Bins of under `least` weight, and their
    neighbours, are NULL; a source of which more than `most_masked` of the bins are
    goes. Fibers without spectra don't count.
    """
    own = [k for k in keys if k in sources.columns]
    there, held = seeing in sources.columns, [*keys, fiber]
    at = F.struct("ra", "dec", *([F.col(seeing).alias("seeing")] if there else []))
    named = sources.groupBy(*own, source).agg(F.array_sort(F.collect_list(at)).alias("__at"))
    named = cut(named.withColumn("__one", F.min(F.struct(F.col(source).alias("id"))).over(Window.partitionBy(*own, "__at"))["id"]))
    ones = named.where(F.col(source).eqNullSafe(F.col("__one"))).select(*own, "__one", F.explode("__at").alias("at"))
    ones = ones.select(*own, "__one", "at.ra", "at.dec", *([F.col("at.seeing").alias(seeing)] if there else []))
    place = fibers.where(F.col(flux).isNotNull() & F.col(error).isNotNull()).withColumn("__angle", angle.cast("double"))
    near = within_radius(ones, place.select(*held, "ra", "dec"), radius, flat=True, keys=own)
    pairs = near.select(
        *[F.col(f"{k}_r").alias(k) for k in held], F.col("__one_l").alias("__one"), F.col("dra").alias("__dx"), F.col("ddec").alias("__dy"), *([F.col(f"{seeing}_l").alias(seeing)] if there else [])
    )
    by = [*keys, "__one"]
    spectra = place.select(*held, "__angle", F.col(flux).cast("array<double>").alias(flux), F.col(error).cast("array<double>").alias(error), *([] if there else [seeing]))
    met = pairs.join(spectra, held).withColumn("__part", F.pmod(F.xxhash64(fiber), F.lit(parts)))
    sorted_ = dealt(met, *by, "__part").sortWithinPartitions(*by)
    sums = _summed(sorted_, by, profile, flux, error, seeing)
    rows = sums.select(*by, F.posexplode(F.arrays_zip(*_SUMS)).alias(i, "s")).groupBy(*by, i).agg(*[F.sum(f"s.{c}").alias(c) for c in _SUMS])
    rows = rows.select(
        *by, i, F.try_divide("__fg", "__gg").alias("flux"), F.sqrt(F.try_divide("__ge", "__gg")).alias("error"), F.col("__g").alias("weight"), (F.col("__g") < least).alias("__low")
    )
    rows = dilate(rows, by, i, "__low", 1, "__bad").withColumn("__bad", F.col("__bad") | F.col("flux").isNull())
    share = F.avg(F.col("__bad").cast("int")).over(Window.partitionBy(*by))
    shown = lambda c: F.when(~F.col("__bad"), F.col(c)).alias(c)
    rows = rows.withColumn("__share", share).where(F.col("__share") <= most_masked)
    whole = rows.groupBy(*by).agg(F.collect_list(F.struct(i, shown("flux"), shown("error"), "weight")).alias("__bins"))
    # a few dozen numbers a bin; dealt by the sources, which may be many of one place
    whole = few(whole, FEW * 30 // len(profile.waves))
    ids = dealt(named.select(*[F.col(k).alias(f"__own_{k}") for k in own], F.col(source).alias("__id"), F.col("__one").alias("__of")), "__id")
    same = F.col("__of").eqNullSafe(F.col("__one"))
    for k in own:
        same = same & (F.col(f"__own_{k}") == F.col(k))
    return ids.join(whole, same).select(*keys, F.col("__id").alias(source), F.inline("__bins"))


def normalised(spectra: DataFrame, keys: Sequence[str], i: str, response: DataFrame, catalog: DataFrame, mag: str, curve: DataFrame | None = None) -> DataFrame:
    """Spectra (flux, error) scaled to their catalog magnitudes through a response(i, response), after an optional flux curve(i, factor).

    catalog: some of the keys, and the magnitude. A spectrum without a magnitude of
    its own or in the catalog keeps its scale.
    """
    rows = spectra if curve is None else spectra.join(few(curve.select(i, F.col("factor").alias("__c"))), i, "left")
    if curve is not None:
        rows = rows.withColumns({c: F.col(c) * F.coalesce("__c", F.lit(1.0)) for c in ("flux", "error")}).drop("__c")
    shared = [k for k in keys if k in catalog.columns]
    own = response_magnitude(rows, few(response), keys, i, "flux").join(catalog.select(*shared, F.col(mag).alias("__mag")), shared, "left")
    scale = own.select(*keys, F.coalesce(F.pow(F.lit(10.0), 0.4 * (F.col("mag") - F.col("__mag"))), F.lit(1.0)).alias("normalisation"))
    rows = rows.join(few(scale), list(keys), "left")
    return rows.withColumns({c: F.col(c) * F.col("normalisation") for c in ("flux", "error")}).select(*spectra.columns, "normalisation")


def refracted_cube(
    fibers: DataFrame, i: str, wave: Column, shot: str, order: str, value: str, angle: Column, center: tuple[Column, Column], scale: float, area: float = 1.0, error: str | None = None
) -> DataFrame:
    """(i, px, py, value, coverage, error): the cube of all shots, each fiber at the place where it looks at each wavelength.

    fibers has a row for each bin, with ra, dec and the value; pixels are `scale`
    arcseconds wide and counted from the center.
    """
    ra, dec = refracted(F.col("ra"), F.col("dec"), wave, angle, *center)
    x, y = to_plane(ra, dec, *center, scale=scale)
    return median_mosaic(fibers.withColumn("__px", x).withColumn("__py", y), [i], shot, order, "__px", "__py", value, area, error)


def tile_cells(tiles: DataFrame, tile: str, half: int, step: float) -> DataFrame:
    """(tile, cell, cx, cy, ra, dec): the cells of a square grid of 2 half + 1 cells a side, `step` arcseconds apart, about each tile's ra and dec."""
    side = 2 * half + 1
    cells = tiles.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
    cells = cells.withColumn("cx", F.col("cell") % side - half).withColumn("cy", F.floor(F.col("cell") / side).cast("int") - half)
    ra = F.col("ra") + F.col("cx") * step / 3600 / F.cos(F.radians("dec"))
    return cells.select(tile, "cell", "cx", "cy", ra.alias("ra"), (F.col("dec") + F.col("cy") * step / 3600).alias("dec"))


def tile_cube(
    fibers: DataFrame, tiles: DataFrame, tile: str, exposure: str, half: int, step: float, fiber: str, flux: str, error: str, seeing: str, radius: float, profile: Profile,
    angle: Column, least: float = 0.05, i: str = "idx",
) -> DataFrame:
    """(tile, cx, cy, i, flux, error): every cell of every tile extracted as a source in each exposure, and the exposures coadded.

    Before that an exposure's errors are scaled by the scatter of its spectrum about
    the cell's median. A fiber goes to the cells within its reach, whatever tile
    they belong to, so a cell's values don't depend on how the sky is cut in tiles.
    """
    cells = tile_cells(tiles, tile, half, step).withColumn("__spaxel", F.struct(tile, "cx", "cy"))
    one = extract_sources(fibers, cells.select("__spaxel", "ra", "dec"), [exposure], "__spaxel", fiber, flux, error, seeing, radius, profile, angle, least, 1.0, i)
    at = Window.partitionBy("__spaxel", i)
    one = one.withColumn("__r", F.try_divide(F.col("flux") - median(F.col("flux")).over(at), F.col("error")))
    scale = mad_std(one, ["__spaxel", exposure], "__r", out="__scale")
    ready = one.join(scale, ["__spaxel", exposure]).withColumn("error", F.col("error") * F.when(F.col("__scale") > 0, F.col("__scale")).otherwise(1.0))
    return coadd(ready, ["__spaxel", i], "flux", "error").select(f"__spaxel.{tile}", "__spaxel.cx", "__spaxel.cy", i, "flux", "error")


def exposure_extract(
    samples: DataFrame, keys: Sequence[str], i: str, flux: str, error: str, weight: str, n_chunks: int = 21, degree: int = 3, least: float = 0.4, faint: float = 0.1
) -> DataFrame:
    """(keys, i, flux, error, weight, smooth): the variance-weighted spectrum of one source in one exposure.

    The summed weight of valid fibers is compared with the polynomial through
    its chunks' medians: bins of under `least` of it are NULL, and all are where
    the polynomial's median is under `faint`.
    """
    iv = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    ok, w = F.col(flux).isNotNull(), F.col(weight)
    sums = samples.groupBy(*keys, i).agg(
        F.try_divide(F.sum(F.col(flux) * w * iv), F.sum(w * w * iv)).alias("flux"),
        F.sqrt(F.try_divide(F.sum(w), F.sum(w * w * iv))).alias("error"),
        F.coalesce(F.sum(F.when(ok, w)), F.lit(0.0)).alias("weight"),
    )
    whole = Window.partitionBy(*keys)
    part = F.ntile(n_chunks).over(whole.orderBy(i))
    rows = sums.withColumn("__chunk", part).withColumn("__lo", F.min(i).over(whole)).withColumn("__hi", F.max(i).over(whole))
    u = lambda x: F.coalesce(F.try_divide(2 * (F.col(x) - F.col("__lo")), F.col("__hi") - F.col("__lo")) - 1, F.lit(0.0))
    points = rows.groupBy(*keys, "__chunk", "__lo", "__hi").agg(F.avg(i).alias("__at"), median(F.col("weight")).alias("__y"))
    fit = linear_fit(points.withColumn("__u", u("__at")), keys, powers(F.col("__u"), degree), F.col("__y")).select(*keys, F.col("coef").alias("__coef"))
    both = rows.join(fit, list(keys), "left").withColumn("__u", u(i)).withColumn("smooth", evaluate(F.col("__coef"), powers(F.col("__u"), degree)))
    both = both.withColumn("__faint", median(F.col("smooth")).over(whole) < faint)
    keep = ~(F.coalesce(F.try_divide("weight", "smooth"), F.lit(0.0)) < least) & ~F.coalesce("__faint", F.lit(True))
    shown = lambda c: F.when(keep, F.col(c)).alias(c)
    return both.select(*keys, i, shown("flux"), shown("error"), "weight", "smooth")


def weight_mask(spectra: DataFrame, keys: Sequence[str], i: str, weight: str, degree: int = 3, low: float = 0.3, dip: float = 0.8, faint: float = 0.05, least: int = 100) -> DataFrame:
    """Adds masked: bins of weights below `dip` of their polynomial and their neighbours; all bins of faint or short spectra.

    The polynomial is fitted to the weights above `low` of the median.
    """
    whole = Window.partitionBy(*keys)
    rows = spectra.withColumn("__m", median(F.col(weight)).over(whole)).withColumn("__lo", F.min(i).over(whole)).withColumn("__hi", F.max(i).over(whole))
    rows = rows.withColumn("__u", F.coalesce(F.try_divide(2 * (F.col(i) - F.col("__lo")), F.col("__hi") - F.col("__lo")) - 1, F.lit(0.0)))
    rows = rows.withColumn("__y", F.when(F.col(weight) > low * F.col("__m"), F.col(weight)))
    fit = linear_fit(rows, keys, powers(F.col("__u"), degree), F.col("__y")).select(*keys, F.col("coef").alias("__coef"), F.col("n").alias("__n"))
    rows = rows.join(fit, list(keys), "left")
    below = F.coalesce(F.col(weight) < dip * evaluate(F.col("__coef"), powers(F.col("__u"), degree)), F.lit(True))
    rows = dilate(rows.withColumn("__dip", below), keys, i, "__dip", 1, "__near")
    all_of = (F.coalesce("__n", F.lit(0)) < least) | F.coalesce(F.col("__m") < faint, F.lit(True))
    return rows.withColumn("masked", F.col("__near") | all_of).select(*spectra.columns, "masked")


def line_image(spectra: DataFrame, fiber: str, i: str, flux: str, x: str, y: str, center: float, width: float, half: float, side: float, sigma: float, reach: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, px, py, flux, weight): the images of a line, one by keys: flux over the side bands' biweight, with Gaussian weights along the line, splatted at the fibers."""
    gap = F.abs(F.col(i) - center)
    bands = spectra.withColumn("__band", F.when(gap <= half, "line").when(gap <= half + side, "side"))
    back = biweight(bands.where("__band = 'side'"), [*keys, fiber], flux, loc="__back", scale=None)
    w = F.exp(-0.5 * F.pow((F.col(i) - center) / width, 2))
    line = bands.where(F.col("__band") == "line").join(back, [*keys, fiber]).withColumn("__w", F.when(F.col(flux).isNotNull(), w))
    at = line.groupBy(*keys, fiber).agg(
        F.first(x).alias("x"), F.first(y).alias("y"), F.try_divide(F.sum((F.col(flux) - F.col("__back")) * F.col("__w")), F.sum(F.col("__w") * F.col("__w"))).alias("flux")
    )
    return splat(at, list(keys), "x", "y", "flux", sigma, reach, 0.1)


def collapse(spectra: DataFrame, keys: Sequence[str], i: str, flux: str, error: str, response: Column, sky: Column | None = None, per: Sequence[str] = ()) -> DataFrame:
    """(keys, flux, error): the broadband value by keys through a response; with `sky`, less the biweight, by `per` (an exposure, say) and bin, of the rows where it holds."""
    rows = spectra.withColumn("__f", F.col(flux))
    if sky is not None:
        back = biweight(spectra.where(sky), [*per, i], flux, loc="__back", scale=None)
        rows = rows.join(back, [*per, i], "left").withColumn("__f", F.col(flux) - F.coalesce("__back", F.lit(0.0)))
    ok = F.col(flux).isNotNull() & (F.col(flux) != 0) & (response > 0)
    total = F.sum(F.when(ok, response))
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(ok, F.col("__f") * response)), total).alias("flux"), F.sqrt(F.try_divide(F.sum(F.when(ok, F.col(error) * F.col(error) * response)), total)).alias("error")
    )


def without_background(voxels: DataFrame, keys: Sequence[str], i: str, flux: str, empty: Column) -> DataFrame:
    """voxels less the mean spectrum of the source-free cells (those where `empty` holds), by keys."""
    back = voxels.where(empty).groupBy(*keys, i).agg(F.avg(flux).alias("__back"))
    return voxels.join(back, [*keys, i], "left").withColumn(flux, F.col(flux) - F.coalesce("__back", F.lit(0.0))).drop("__back")


def sn_cube(voxels: DataFrame, cell: Sequence[str], i: str, flux: str, error: str, bins: int, kernel: Sequence[float], field: Sequence[str] = ()) -> DataFrame:
    """Adds sn: flux without its continuum over error, both smoothed along the spectrum by the line's kernel, scaled to a 1.4826 MAD of 1 by field and bin.

    cell: the keys of a spectrum, those of its field among them.
    """
    rows = continuum(voxels, cell, i, flux, bins, "__level").withColumn("__line", F.col(flux) - F.col("__level"))
    rows = smooth(rows, cell, i, "__line", kernel, "__s")
    rows = smooth(rows, cell, i, error, kernel, "__e", error=True).withColumn("__sn", F.try_divide("__s", "__e"))
    noise = mad_std(rows, [*field, i], "__sn", out="__noise")
    return rows.join(noise, [*field, i]).withColumn("sn", F.try_divide("__sn", "__noise")).select(*voxels.columns, "sn")


def line_fit_grid(
    samples: DataFrame, keys: Sequence[str], i: str, flux: str, error: str, center: str, reach: float, steps: int, widths: Sequence[float], half: float
) -> DataFrame:
    """(keys, centre, width, amplitude, chi2, flux): the Gaussian of the least chi-square near a peak.

    Centers within `reach` of the given one and widths (sigma) are tried on a
    grid; the amplitude is free. Bins within `half` of the peak count; a peak with
    a missing one has no fit.
    """
    rows = samples.where(F.abs(F.col(i) - F.col(center)) <= half)
    gap = F.max(F.col(flux).isNull().cast("int")).over(Window.partitionBy(*keys))
    rows = rows.withColumn("__gap", gap).where("__gap = 0")
    tried = F.array(*[F.struct(F.lit(reach * (2 * n / (steps - 1) - 1)).alias("d"), F.lit(float(s)).alias("s")) for n in range(steps) for s in widths])
    rows = rows.withColumn("__t", F.explode(tried)).withColumn("__g", F.exp(-0.5 * F.pow((F.col(i) - F.col(center) - F.col("__t.d")) / F.col("__t.s"), 2)))
    iv = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    sums = rows.groupBy(*keys, center, F.col("__t.d").alias("__d"), F.col("__t.s").alias("width")).agg(
        F.sum(F.col(flux) * F.col(flux) * iv).alias("yy"), F.sum(F.col(flux) * F.col("__g") * iv).alias("yg"), F.sum(F.col("__g") * F.col("__g") * iv).alias("gg"), F.count("*").alias("n")
    )
    amp = F.try_divide("yg", "gg")
    chi = sums.withColumn("amplitude", amp).withColumn("chi2", F.try_divide(F.col("yy") - F.col("yg") * amp, F.col("n") - 3))
    best = Window.partitionBy(*keys).orderBy("chi2", "__d", "width")
    out = chi.where("chi2 is not null").withColumn("__r", F.row_number().over(best)).where("__r = 1")
    return out.select(*keys, (F.col(center) + F.col("__d")).alias("centre"), "width", "amplitude", "chi2", (F.col("amplitude") * F.col("width") * math.sqrt(2 * math.pi)).alias("flux"))


def moment_spectrum(cube: DataFrame, source: Sequence[str], pixel: Sequence[str], i: str, flux: str, n_chunks: int = 11) -> DataFrame:
    """(source, i, flux): the spectrum of a source's cube, weighted by its collapsed image: the sum over chunks of each pixel's medians."""
    parts = cube.withColumn("__c", F.ntile(n_chunks).over(Window.partitionBy(*source, *pixel).orderBy(i)))
    image = parts.groupBy(*source, *pixel, "__c").agg(median(F.col(flux)).alias("__m")).groupBy(*source, *pixel).agg(F.sum("__m").alias("__m"))
    image = image.withColumn("__w", F.try_divide(F.col("__m"), F.sum("__m").over(Window.partitionBy(*source)))).drop("__m")
    met = cube.join(image, [*source, *pixel])
    return met.groupBy(*source, i).agg(F.try_divide(F.sum(F.col(flux) * F.col("__w")), F.sum(F.col("__w") * F.col("__w"))).alias("flux"))


def two_pixel_extract(frame: DataFrame, trace: DataFrame, keys: Sequence[str], value: str, error: str, flat: str) -> DataFrame:
    """(keys, fiber, col, flux, error, twilight): the two rows about the trace, over the flat; twilight: the flat's own mean.

    A fiber whose trace leaves the frame anywhere has no rows.
    """
    size = frame.groupBy(*keys).agg(F.max("row").alias("__last"))
    whole = Window.partitionBy(*keys, "fiber")
    inside = trace.join(size, list(keys)).withColumn("__lo", F.min("trace").over(whole)).withColumn("__hi", F.max(F.ceil("trace")).over(whole))
    inside = inside.where("__lo >= 0 and __hi <= __last")
    near = inside.select(*keys, "fiber", "col", F.explode(F.array(F.floor("trace").cast("int"), F.ceil("trace").cast("int"))).alias("row"))
    met = near.join(frame.withColumn("row", F.col("row").cast("int")), [*keys, "row", "col"])
    return met.groupBy(*keys, "fiber", "col").agg(
        (F.sum(F.try_divide(value, flat)) / 2).alias("flux"), (F.sqrt(F.sum(F.try_divide(F.col(error) * F.col(error), F.col(flat)))) / 2).alias("error"), (F.sum(flat) / 2).alias("twilight")
    )


def shifted(spectra: DataFrame, keys: Sequence[str], i: str, flux: str, shift: str, places: DataFrame, at: str = "at") -> DataFrame:
    """Spectra moved by a shift of their own: the samples stand at i - shift and are read again at the places."""
    return rectify(spectra.withColumn("__x", F.col(i) - F.col(shift)), keys, "__x", flux, places, at)


def response_on(curve: DataFrame, x: str, y: str, grid: DataFrame, at: str) -> DataFrame:
    """(at, response): a filter curve on a grid, 0 outside of its samples, of unit sum."""
    rows = rectify(curve.withColumn("__curve", F.lit(0)), ["__curve"], x, y, grid, at).select(at, F.col(y).alias("__y"))
    filled = grid.select(F.col(at).cast("double").alias(at)).join(rows, at, "left").withColumn("__y", F.coalesce("__y", F.lit(0.0)))
    total = filled.agg(F.sum("__y").alias("__t"))
    return filled.crossJoin(F.broadcast(total)).select(at, F.try_divide("__y", "__t").alias("response"))


def response_magnitude(spectra: DataFrame, response: DataFrame, keys: Sequence[str], i: str, flux: str, weight: str | None = None, least: float = 0.7, zero_point: float = 23.9) -> DataFrame:
    """(keys, mag): AB magnitudes through a response(i, response); with weights, only bins above `least` of the key's median weight count."""
    rows = spectra.join(response, i)
    ok = F.col(flux).isNotNull()
    if weight:
        rows = rows.withColumn("__m", median(F.col(weight)).over(Window.partitionBy(*keys)))
        ok = ok & (F.col(weight) > least * F.col("__m"))
    mean = F.try_divide(F.sum(F.when(ok, F.col(flux) * F.col("response"))), F.sum(F.when(ok, F.col("response"))))
    return rows.groupBy(*keys).agg(mean.alias("__f")).select(*keys, F.when(F.col("__f") > 0, -2.5 * F.log10(F.col("__f")) + zero_point).alias("mag"))
