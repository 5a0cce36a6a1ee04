"""Detector frames and exposure corrections: array rows of one frame line, or long rows of pixels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, few
from .ordering import global_biweight, quantiles
from .robust import MAD_TO_SIGMA, biweight, biweight_of, median, sigma_clip

# What a frame's header falls back to.
DEFAULT_GAIN, DEFAULT_READ_NOISE = 0.85, 3.0


def flipped(values: Column, flip: Column) -> Column:
    """A frame line's values, reversed where the amp is read from the other side."""
    return F.when(flip, F.reverse(values)).otherwise(values)


def base_reduce(frames: DataFrame, keys: Sequence[str], row: str, values: str, overscan: int, gain: str, read_noise: str, by_row: bool = False) -> DataFrame:
    """Frame lines without their overscan level (biweight of the frame's, or of each line's), trimmed, in electrons, with errors.

    The last `overscan` values of a line are the overscan. A gain of 0 or less
    is 0.85, a read noise of 0 or less is 3; error = sqrt(rn^2 + max(value, 0)).
    """
    level_keys = [*keys, row] if by_row else list(keys)
    over = frames.select(*keys, row, F.explode(F.slice(values, F.size(values) - overscan + 1, overscan)).alias("__o"))
    level = biweight(over.withColumn("__o", F.col("__o").cast("double")), level_keys, "__o", loc="__level", scale=None)
    g = F.when(F.col(gain) > 0, F.col(gain)).otherwise(F.lit(DEFAULT_GAIN))
    rn = F.when(F.col(read_noise) > 0, F.col(read_noise)).otherwise(F.lit(DEFAULT_READ_NOISE))
    rows = frames.join(level, level_keys).withColumn("__g", g).withColumn("__rn", rn)
    rows = rows.withColumn(values, F.transform(F.slice(values, 1, F.size(values) - overscan), lambda x: (x - F.col("__level")) * F.col("__g")))
    rows = rows.withColumn("error", F.transform(values, lambda x: F.sqrt(F.col("__rn") * F.col("__rn") + F.greatest(x, F.lit(0.0)))))
    return rows.select(*keys, row, values, "error")


def subtract_master(frames: DataFrame, master: DataFrame, keys: Sequence[str], values: str, master_values: str, scale: Column | None = None) -> DataFrame:
    """Frame lines without the master's line (times a scale of the frame)."""
    joined = frames.join(master.select(*keys, F.col(master_values).alias("__m")), list(keys))
    s = F.lit(1.0) if scale is None else scale
    return joined.withColumn(values, F.zip_with(values, "__m", lambda a, b: a - b * s)).drop("__m")


def pixel_flat_mask(flat: Column, most: float = 0.1) -> Column:
    """Whether a pixel's flat is further than `most` from 1."""
    return F.coalesce(F.abs(flat - 1) > most, F.lit(True))


def line_window(i: Column, center: float, half: float, side: float) -> Column:
    """line, side or NULL: bins within `half` of the center, and the side bands of width `side` around them."""
    d = F.abs(i - center)
    return F.when(d <= half, "line").when(d <= half + side, "side")


def with_dither(df: DataFrame, offsets: Mapping[int, tuple[float, float]], exp: str, x: str, y: str, n_exposures: str) -> DataFrame:
    """Positions moved by their exposure's dither, only where there are as many exposures as offsets."""
    all_of = F.col(n_exposures) == len(offsets)
    pick = lambda k: F.coalesce(*[F.when(F.col(exp) == e, F.lit(o[k])) for e, o in offsets.items()], F.lit(0.0))
    move = lambda c, k: F.when(all_of, F.col(c) + pick(k)).otherwise(F.col(c))
    return df.withColumns({x: move(x, 0), y: move(y, 1)})


def alternate_position(ra: Column, dec: Column, ra2: Column, dec2: Column, apart: Column, most: float = 25.0) -> tuple[Column, Column]:
    """The alternate coordinates where they are further than `most` arcseconds apart (or the first are missing)."""
    other = F.coalesce(apart > most, F.lit(True)) & ra2.isNotNull() & dec2.isNotNull()
    return F.when(other, ra2).otherwise(ra), F.when(other, dec2).otherwise(dec)


def without_bad_amps(df: DataFrame, listed: DataFrame, keys: Sequence[str], sigma: str, most: float = 1.2) -> DataFrame:
    """Rows of amps that are neither listed nor noisier than `most`."""
    return df.join(listed.select(*keys).distinct(), list(keys), "left_anti").where(F.col(sigma) <= most)


def residual_throughput(fibers: DataFrame, fiber: str, value: str, n_sigma: float = 2.0) -> DataFrame:
    """By fiber the biweight location and scale over exposures, and whether it is off by n_sigma of all fibers' scale."""
    by = biweight(fibers, [fiber], value)
    whole = global_biweight(by, F.col("location"), loc="__loc", scale="__scale")
    both = by.crossJoin(F.broadcast(whole))
    return both.select(fiber, "location", "scale", (F.abs(F.col("location") - F.col("__loc")) > n_sigma * F.col("__scale")).alias("flagged"))


def fiber_correction(spectra: DataFrame, amp: str, exp: str, fiber: str, value: str, least: int = 18) -> DataFrame:
    """By amp and fiber the biweight over exposures of the value relative to its amp's level; NULL with too few."""
    level = biweight(spectra, [amp, exp], value, loc="__level", scale=None)
    rel = spectra.join(level, [amp, exp]).withColumn("__rel", F.try_divide(F.col(value), F.col("__level")))
    counts = rel.groupBy(amp, fiber).agg(F.count("__rel").alias("n"))
    out = biweight(rel, [amp, fiber], "__rel", loc="__corr", scale=None).join(counts, [amp, fiber])
    return out.select(amp, fiber, "n", F.when(F.col("n") >= least, F.col("__corr")).alias("correction"))


def position_drift(samples: DataFrame, keys: Sequence[str], chunk: str, x: str, y: str) -> DataFrame:
    """By chunk of wavelength: the median centroid without the median of all."""
    whole = samples.groupBy(*keys).agg(median(F.col(x)).alias("__x"), median(F.col(y)).alias("__y"))
    parts = samples.groupBy(*keys, chunk).agg(median(F.col(x)).alias("dx"), median(F.col(y)).alias("dy"))
    return parts.join(whole, list(keys)).select(*keys, chunk, (F.col("dx") - F.col("__x")).alias("dx"), (F.col("dy") - F.col("__y")).alias("dy"))


def single_pass_sky(spectra: DataFrame, exp: str, fiber: str, i: str, flux: str, n_sigma: float = 3.0) -> DataFrame:
    """Sky by exposure and bin: the biweight of the fibers in the middle third by median flux, clipped once."""
    levels = spectra.groupBy(exp, fiber).agg(median(F.col(flux)).alias("__level"))
    third = F.ntile(3).over(Window.partitionBy(exp).orderBy("__level", fiber))
    middle = levels.withColumn("__third", third).where("__third = 2").select(exp, fiber)
    clipped = sigma_clip(spectra.join(middle, [exp, fiber], "left_semi"), [exp, i], flux, n_sigma, rounds=1, out="__c")
    return biweight(clipped, [exp, i], "__c", loc="sky", scale=None)


def image_background(pixels: DataFrame, keys: Sequence[str], value: str, levels: int = 26) -> DataFrame:
    """The background with the least relative scatter: of `levels` equal steps between the 5th and 60th percentile, the values below which vary least.

    Equal values are counted first, so that a level's copy is one of distinct values.
    Keys of more than _CROWDED values are left where they are: their percentiles are
    found by counting, and only sums are shuffled.
    """
    if not keys:
        return image_background(pixels.withColumn("__all", F.lit(0)), ["__all"], value, levels).drop("__all")
    pixels = pixels.where(F.col(value).isNotNull()).select(*keys, value)
    crowded = cut(pixels.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > _CROWDED).drop("__n"))
    if crowded.isEmpty():
        return _counted_background(pixels, keys, value, levels)
    rest = _counted_background(pixels.join(crowded, list(keys), "left_anti"), keys, value, levels)
    return rest.unionByName(_crowded_background(pixels.join(few(crowded), list(keys)), keys, value, levels))


#: Most values of a key that windows are laid over.
_CROWDED = 1_000_000


def _levels(ends: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """(keys, __i, __top): the equal steps between both of __p."""
    grid = ends.select(*keys, "__p", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("__i"))
    return grid.select(*keys, "__i", (F.col("__p")[0] + (F.col("__p")[1] - F.col("__p")[0]) * F.col("__i") / levels).alias("__top"))


def _steadiest(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    rel = F.try_divide(F.col("scale"), F.abs("location"))
    best = stats.where(rel.isNotNull()).withColumn("__rel", rel).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__rel", "__i")))
    return best.where("__r = 1").select(*keys, F.col("location").alias("background"), F.col("scale").alias("noise"))


def _counted_background(pixels: DataFrame, keys: Sequence[str], value: str, levels: int) -> DataFrame:
    pixels = pixels.groupBy(*keys, value).agg(F.count("*").alias("__times"))
    ends = pixels.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.6)), F.col("__times")).alias("__p"))
    below = pixels.join(_levels(ends, keys, levels), list(keys)).where(F.col(value) <= F.col("__top"))
    return _steadiest(biweight(below, [*keys, "__i"], value, times="__times"), keys)


def _crowded_background(pixels: DataFrame, keys: Sequence[str], value: str, levels: int) -> DataFrame:
    group, x = [*keys, "__i"], F.col(value).cast("double")
    grid = cut(_levels(quantiles(pixels, keys, x, [0.05, 0.6]).withColumnRenamed("q", "__p"), keys, levels))
    below = lambda grid: pixels.join(few(grid), list(keys)).where(F.col(value) <= F.col("__top"))
    middle = quantiles(below(grid), group, x, [0.5]).select(*group, F.col("q")[0].alias("__m"))
    grid = cut(grid.join(middle.hint("shuffle_hash"), group))
    apart = quantiles(below(grid), group, F.abs(x - F.col("__m")), [0.5]).select(*group, F.col("q")[0].alias("__mad"))
    grid = grid.join(apart.hint("shuffle_hash"), group)
    return _steadiest(biweight_of(below(grid).withColumn("__d", x - F.col("__m")), group), keys)


def contrast(profiles: DataFrame, keys: Sequence[str], peak: str, valley: str) -> DataFrame:
    """Percentiles 5, 50 and 95 of (peak - 2 valley) / (peak + 2 valley)."""
    c = F.try_divide(F.col(peak) - 2 * F.col(valley), F.col(peak) + 2 * F.col(valley))
    p = profiles.groupBy(*keys).agg(F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("__p"))
    return p.select(*keys, *[F.col("__p")[k].alias(f"p{n}") for k, n in enumerate((5, 50, 95))])


def photometric_offset(stars: DataFrame, keys: Sequence[str], delta: str, seeing: str, rounds: int = 5, n_sigma: float = 3.0) -> DataFrame:
    """Offset, seeing and count of stars after clipping both in turns."""
    w = Window.partitionBy(*keys)
    now = stars.withColumn("__ok", F.col(delta).isNotNull() & F.col(seeing).isNotNull())
    for _ in range(rounds):
        for c in (delta, seeing):
            x = F.when(F.col("__ok"), F.col(c))
            now = now.withColumn("__m", median(x).over(w))
            now = now.withColumn("__s", median(F.abs(F.when(F.col("__ok"), F.col(c)) - F.col("__m"))).over(w) * MAD_TO_SIGMA)
            now = now.withColumn("__ok", F.col("__ok") & (F.abs(F.col(c) - F.col("__m")) <= n_sigma * F.col("__s")))
    kept = now.where("__ok")
    return kept.groupBy(*keys).agg(median(F.col(delta)).alias("offset"), median(F.col(seeing)).alias("fwhm"), F.count("*").alias("n_stars"))


def amp_levels(spectra: DataFrame, amp: str, exp: str, chunk: str, value: str) -> DataFrame:
    """Biweight of each amp relative to its exposure's, by wavelength chunk."""
    own = biweight(spectra, [amp, exp, chunk], value, loc="__own", scale=None)
    whole = biweight(spectra, [exp, chunk], value, loc="__all", scale=None)
    return own.join(whole, [exp, chunk]).select(amp, exp, chunk, F.try_divide("__own", "__all").alias("level"))
