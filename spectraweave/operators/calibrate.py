"""Masters, sky, masks and co-adds over long rows of frames and fiber spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .robust import MAD_TO_SIGMA, biweight, mad_std, median, sigma_clip, sky_fibers, with_deviation
from .windows import dilate, ordered, running_percentile


def master_frame(frames: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and 1.4826 MAD of each pixel over frames; keys name the amp, kind and pixel."""
    return with_deviation(frames, keys, value).groupBy(*keys).agg(F.first("__m", True).alias("master"), (F.first("__mad", True) * MAD_TO_SIGMA).alias("scatter"))


def arc_master(frames: DataFrame, keys: Sequence[str], lamp: str, value: str) -> DataFrame:
    """Sum over lamps of the lamps' medians, and mean of their scatters."""
    by_lamp = master_frame(frames, [*keys, lamp], value)
    return by_lamp.groupBy(*keys).agg(F.sum("master").alias("master"), F.avg("scatter").alias("scatter"))


def mean_time(frames: DataFrame, keys: Sequence[str], ts: str, order: str) -> DataFrame:
    """Midpoint in seconds of the first and last frame of the list."""
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return frames.groupBy(*keys).agg(((F.min_by(sec, order) + F.max_by(sec, order)) / 2).alias("mean_time"))


def scaled_twilight(frames: DataFrame, keys: Sequence[str], frame: str, pixel: str, value: str) -> DataFrame:
    """Median over frames of each pixel relative to its frame's median, times the median of those medians."""
    level = frames.groupBy(*keys, frame).agg(median(F.col(value)).alias("__level"))
    overall = level.groupBy(*keys).agg(median(F.col("__level")).alias("__all"))
    rel = frames.join(level, [*keys, frame]).withColumn("__r", F.try_divide(F.col(value), F.col("__level")))
    return rel.groupBy(*keys, pixel).agg(median(F.col("__r")).alias("__r")).join(overall, list(keys)).select(*keys, pixel, (F.col("__r") * F.col("__all")).alias("twilight"))


def read_noise(frames: DataFrame, keys: Sequence[str], pixel: str, value: str) -> DataFrame:
    """Biweight over pixels of each pixel's scatter over frames."""
    return biweight(master_frame(frames, [*keys, pixel], value), keys, "scatter", loc="read_noise", scale=None)


def hot_pixels(dark: DataFrame, keys: Sequence[str], row: str, col: str, value: str, n_sigma: float = 5.0, bright: float = 100.0) -> DataFrame:
    """Adds whether a pixel is hot: off by n_sigma after column and row medians are taken away.

    A whole column is hot if a pixel above `bright` has a hot one just after it
    that is not the last row.
    """
    by_col, by_row = Window.partitionBy(*keys, col), Window.partitionBy(*keys, row)
    rows = dark.withColumn("__y", F.col(value) - median(F.col(value)).over(by_col))
    rows = rows.withColumn("__y", F.col("__y") - median(F.col("__y")).over(by_row))
    clipped = sigma_clip(rows, keys, "__y", 3.0, rounds=5, scale="std", out="__c")
    whole = Window.partitionBy(*keys)
    rows = clipped.withColumn("__hot", F.abs("__y") > n_sigma * F.stddev_pop("__c").over(whole)).withColumn("__last", F.max(row).over(whole))
    below = F.coalesce(F.lead("__hot").over(ordered([*keys, col], row)), F.lit(False))
    streak = (F.col("__y") > bright) & below & (F.col(row) + 2 <= F.col("__last"))
    rows = rows.withColumn("__s", streak.cast("int")).withColumn("hot", F.col("__hot") | (F.max("__s").over(by_col) == 1))
    return rows.drop("__y", "__c", "__hot", "__last", "__s")


def flat_defects(
    flat: DataFrame, keys: Sequence[str], row: str, col: str, value: str, size: int = 17, level: float = 200.0, off: float = 0.1, edge: int = 8, most: int = 300
) -> DataFrame:
    """Adds whether a flat's pixel is off by more than `off` from its row's running median; columns with over `most` are all defects."""
    rows = running_percentile(flat, [*keys, row], col, value, size, out="__run")
    ends = Window.partitionBy(*keys)
    rows = rows.withColumn("__low", F.min(col).over(ends)).withColumn("__high", F.max(col).over(ends))
    bad = (F.abs(F.try_divide(F.col(value) - F.col("__run"), F.col("__run"))) > off) & (F.col("__run") >= level)
    bad = bad & (F.col(col) >= F.col("__low") + edge) & (F.col(col) <= F.col("__high") - edge)
    rows = rows.withColumn("__bad", F.coalesce(bad, F.lit(False)))
    count = F.sum(F.col("__bad").cast("int")).over(Window.partitionBy(*keys, col))
    return rows.withColumn("defect", F.col("__bad") | (count > most)).drop("__run", "__low", "__high", "__bad")


def block_masters(frames: DataFrame, keys: Sequence[str], number: str, pixel: str, value: str) -> DataFrame:
    """Median of each pixel over each run of consecutive file numbers; no frame is left out."""
    numbers = frames.select(*keys, number).distinct()
    w = ordered(keys, number)
    jump = F.coalesce(((F.col(number) - F.lag(number).over(w)) > 1).cast("int"), F.lit(0))
    blocks = numbers.withColumn("__j", jump).withColumn("block", F.sum("__j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__j")
    return frames.join(blocks, [*keys, number]).groupBy(*keys, "block", pixel).agg(median(F.col(value)).alias("master"))


def exposure_sky(spectra: DataFrame, exp: str, fiber: str, i: str, flux: str, low: int, high: int) -> DataFrame:
    """Sky spectrum by exposure: the biweight, bin by bin, of fibers whose level in bins [low, high) is the mode's."""
    window = spectra.where(F.col(i).between(low, high - 1))
    levels = biweight(window, [exp, fiber], flux, loc="level", scale=None)
    sky = sky_fibers(levels, [exp], "level").where("is_sky").select(exp, fiber)
    return biweight(spectra.join(sky, [exp, fiber], "left_semi"), [exp, i], flux, loc="sky", scale=None)


def subtract_sky(spectra: DataFrame, sky: DataFrame, exp: str, i: str, flux: str) -> DataFrame:
    """Adds residual: flux without its exposure's sky."""
    return spectra.join(sky, [exp, i]).withColumn("residual", F.col(flux) - F.col("sky"))


def sky_ratio(sky: DataFrame, exp: str, i: str, first: int) -> DataFrame:
    """Median over bins of each exposure's sky relative to the first exposure's."""
    base = sky.where(F.col(exp) == first).select(i, F.col("sky").alias("__base"))
    return sky.join(base, i).groupBy(exp).agg(median(F.try_divide(F.col("sky"), F.col("__base"))).alias("ratio"))


def residual_map(spectra: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds value without the biweight, over exposures, of the same keys (amp, fiber, bin)."""
    level = biweight(spectra, keys, value, loc="__level", scale=None)
    return spectra.join(level, list(keys)).withColumn("cleaned", F.col(value) - F.col("__level")).drop("__level")


def error_factor(spectra: DataFrame, keys: Sequence[str], i: str, flux: str, error: str, drop_below: float = -0.3) -> DataFrame:
    """By keys: the median over bins of the biweight scale of flux/error, and whether the amp is kept."""
    ratio = spectra.withColumn("__r", F.try_divide(F.col(flux), F.col(error)))
    scales = biweight(ratio, [*keys, i], "__r", loc="__loc", scale="__scale")
    return scales.groupBy(*keys).agg(median(F.col("__scale")).alias("factor")).withColumn("kept", F.col("factor") - 1 >= drop_below)


def noise_ratio(spectra: DataFrame, keys: Sequence[str], residual: str, error: str) -> DataFrame:
    """mad_std of residual / error by keys."""
    return mad_std(spectra.withColumn("__r", F.try_divide(F.col(residual), F.col(error))), keys, "__r", out="noise_ratio")


def coadd(spectra: DataFrame, keys: Sequence[str], flux: str, error: str) -> DataFrame:
    """Inverse-variance mean and its error by keys."""
    w = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    good = F.col(flux).isNotNull() & w.isNotNull()
    total = F.sum(F.when(good, w))
    return spectra.groupBy(*keys).agg(F.try_divide(F.sum(F.when(good, F.col(flux) * w)), total).alias(flux), F.sqrt(F.try_divide(F.lit(1.0), total)).alias(error))


def weighted_extract(spectra: DataFrame, source: str, i: str, flux: str, error: str, weight: str, mask: str | None = None, least: float = 0.05) -> DataFrame:
    """Weighted spectrum, error and weight by source and bin; bins of too little weight, and their neighbours, are NULL."""
    good = F.col(flux).isNotNull() & (F.lit(True) if mask is None else F.col(mask))
    w = F.when(good, F.col(weight))
    sums = spectra.groupBy(source, i).agg(
        F.try_divide(F.sum(F.col(flux) * w), F.sum(w * w)).alias("flux"),
        F.sqrt(F.try_divide(F.sum(w * F.col(error) * F.col(error)), F.sum(w * w))).alias("error"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("weight"),
    )
    rows = dilate(sums.withColumn("__low", F.col("weight") < least), [source], i, "__low", 1, "__bad")
    keep = lambda c: F.when(~F.col("__bad"), F.col(c)).alias(c)
    return rows.select(source, i, keep("flux"), keep("error"), "weight")


def guide_summary(guide: DataFrame, keys: Sequence[str], **defaults: tuple[str, str, float]) -> DataFrame:
    """Medians of valid rows: out=(column, condition, default where none is valid)."""
    return guide.groupBy(*keys).agg(*[F.coalesce(F.percentile(F.when(F.expr(ok), F.col(c)), 0.5), F.lit(d)).alias(k) for k, (c, ok, d) in defaults.items()])


def mask_cascade(
    spectra: DataFrame, amp: str, fiber: str, i: str, flux: str, chi2: str, ftf: str, most_chi2: float = 5.0, least_ftf: float = 0.3, most_bins: int = 200, share: float = 0.2
) -> DataFrame:
    """Adds masked: bad bins, then bad fibers, then bins bad in much of an amp, then bad amps."""
    rows = dilate(spectra.withColumn("__c", F.coalesce(F.col(chi2) > most_chi2, F.lit(False))), [amp, fiber], i, "__c", 2, "__m")
    bad = F.col("__m") | F.coalesce(F.col(ftf) < least_ftf, F.lit(False)) | F.col(flux).isNull() | (F.col(flux) == 0)
    rows = rows.withColumn("__m", F.coalesce(bad, F.lit(True)).cast("int"))
    rows = rows.withColumn("__m", F.when(F.sum("__m").over(Window.partitionBy(amp, fiber)) > most_bins, 1).otherwise(F.col("__m")))
    bins = Window.partitionBy(amp, i)
    rows = rows.withColumn("__m", F.when(F.sum("__m").over(bins) > share * F.count("__m").over(bins), 1).otherwise(F.col("__m")))
    whole = rows.groupBy(amp).agg((F.avg("__m") > share).alias("__amp"))
    return rows.join(whole, amp).withColumn("masked", (F.col("__m") == 1) | F.col("__amp")).drop("__c", "__m", "__amp")


def template(spectra: DataFrame, keys: Sequence[str], wave: str, flux: str, low: float, high: float, bins: int) -> DataFrame:
    """Mean wavelength and biweight flux of equal-width bins of wavelength over all fibers of the keys."""
    binned = spectra.withColumn("bin", F.width_bucket(F.col(wave), F.lit(low), F.lit(high), F.lit(bins))).where(F.col("bin").between(1, bins))
    return binned.groupBy(*keys, "bin").agg(F.avg(wave).alias("wave")).join(biweight(binned, [*keys, "bin"], flux, loc="flux", scale=None), [*keys, "bin"])


def star_zero_point(stars: DataFrame, star: str, exp: str, flux: str, stable: float = 0.15) -> DataFrame:
    """Exposure factors: the median over stars, within `stable` of it, of flux relative to the star's median."""
    typical = stars.groupBy(star).agg(median(F.col(flux)).alias("__typical"))
    rel = stars.join(typical, star).withColumn("__rel", F.try_divide(F.col(flux), F.col("__typical")))
    near = rel.withColumn("__m", median(F.col("__rel")).over(Window.partitionBy(exp))).where(F.abs(F.col("__rel") - F.col("__m")) < stable)
    return near.groupBy(exp).agg(median(F.col("__rel")).alias("factor"), F.count("*").alias("n_stars"))
