"""Amplifier and fiber models: identities, normalisations, offsets, sky rounds, residuals, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sky import to_plane
from .arrays import continuum
from .fits import evaluate, linear_fit, low_rank_projection, plane_fit, poly_fit, powers, template_scale
from .grid import smooth_2d
from .lineage import cut
from .robust import MAD_TO_SIGMA, biweight, mad_std, median, percentile_clip, sigma_clip, sky_fibers
from .windows import chunk, dilate, interpolate_masked, smooth


def dated_identity(slot: Column, date: Column, fixes: Sequence[tuple[str, str, int, int]]) -> Column:
    """The slot a frame belongs to: fixes are (after, before, slot, right slot), both dates left out; the first that holds counts."""
    out = None
    for after, before, wrong, right in fixes:
        hit = (date > F.lit(after).cast("date")) & (date < F.lit(before).cast("date")) & (slot == wrong)
        out = F.when(hit, right) if out is None else out.when(hit, right)
    return slot if out is None else out.otherwise(slot)


def same_unit(df: DataFrame, **wanted: tuple[str, int | str]) -> DataFrame:
    """Rows whose header names the wanted spectrograph, unit and controller: header column = (name, value); numbers are padded to three digits."""
    for column, value in wanted.values():
        text = F.col(column).cast("string")
        df = df.where(F.lpad(text, 3, "0") == f"{value:03d}" if isinstance(value, int) else text == value)
    return df


def catalog_rows(catalog: DataFrame, kind: str, value: str, *not_null: str) -> DataFrame:
    """Catalog rows of a type whose named columns are all there."""
    out = catalog.where(F.col(kind) == value)
    for c in not_null:
        out = out.where(F.col(c).isNotNull())
    return out


def index_slice(df: DataFrame, low: int, high: int, *by: str) -> DataFrame:
    """Rows [low, high) of the list in an order; only `high` rows a partition are kept in the sort."""
    return df.orderBy(*by).limit(high).offset(low)


def in_region(fibers: DataFrame, shot: str, ra0: Column, dec0: Column, half: float, few: int) -> tuple[DataFrame, DataFrame]:
    """(fibers in the image's square region, with x and y; shot, n and warning: `empty`, `low` or NULL, for every shot)."""
    x, y = to_plane(F.col("ra"), F.col("dec"), ra0, dec0)
    placed = fibers.withColumn("x", x).withColumn("y", y)
    inside = F.col("x").between(-half, half) & F.col("y").between(-half, half)
    counts = placed.groupBy(shot).agg(F.count(F.when(inside, 1)).alias("n"))
    warning = F.when(F.col("n") == 0, "empty").when(F.col("n") < few, "low")
    return placed.where(inside), counts.withColumn("warning", warning)


def survey_spectra(spectra: DataFrame, survey: DataFrame, obs_id: str, weight: str, flux: str, keys: tuple[str, str] = ("date", "obs"), least: float = 0.8) -> DataFrame:
    """Extracted spectra with their survey row, by date (8 characters) and number (3 from the tenth) of the observation id; bins of low weight are NULL."""
    day, number = keys
    rows = spectra.withColumn(day, F.substring(obs_id, 1, 8)).withColumn(number, F.substring(obs_id, 10, 3).cast("int"))
    rows = rows.withColumn(flux, F.zip_with(flux, weight, lambda f, w: F.when(w >= least, f)))
    return rows.join(survey, [day, number])


def applied_factors(
    spectra: DataFrame, amp: str, exp: str, value: str, amp_factor: str, exp_factor: str, fit: str, sky: str, deviation: str, model: str, most: float = 0.15, least_model: float = 0.5
) -> DataFrame:
    """Adds applied: value * amp factor / exposure factor * fit - sky / exposure factor; NULL where the amp deviates by more than `most` and the model is above `least_model`."""
    good = ~F.coalesce((F.col(deviation) > most) & (F.col(model) > least_model), F.lit(False))
    blank = F.when(F.col(value) != 0, F.col(value))
    scaled = F.try_divide(blank * F.col(amp_factor), F.col(exp_factor)) * F.col(fit) - F.try_divide(sky, exp_factor)
    return spectra.withColumn("applied", F.when(good, scaled))


def trace_rms(chunks: DataFrame, fit: DataFrame, keys: Sequence[str], at: str, trace: str, fitted: str, least: int = 3) -> DataFrame:
    """1.4826 MAD of measured less fitted trace by keys, over the chunks that were measured; NULL with fewer than `least`."""
    met = chunks.join(fit, [*keys, at]).withColumn("__r", F.when(F.col(trace) != 0, F.col(trace) - F.col(fitted)))
    counts = met.groupBy(*keys).agg(F.count("__r").alias("n"))
    return mad_std(met, keys, "__r", out="rms").join(counts, list(keys)).select(*keys, F.when(F.col("n") >= least, F.col("rms")).alias("rms"), "n")


def amp_offsets(levels: DataFrame, exp: str, amp: str, place: str, level: str, rounds: int = 5, least: int = 11) -> DataFrame:
    """Adds offset: the clipped straight line of an amp's fiber levels over its fibers, relative to the exposure's median; 1 with too few fibers left."""
    keys = [exp, amp]
    rows = sigma_clip(levels, keys, level, 3.0, rounds=rounds, out="__c")
    w = Window.partitionBy(*keys)
    line = F.regr_slope("__c", place).over(w) * F.col(place) + F.regr_intercept("__c", place).over(w)
    rows = rows.withColumn("__line", F.when(F.count("__c").over(w) >= least, line).otherwise(1.0))
    return rows.withColumn("offset", F.try_divide(F.col("__line"), median(F.col("__line")).over(Window.partitionBy(exp)))).drop("__c", "__line")


def clipped_sky(spectra: DataFrame, exp: str, fiber: str, i: str, flux: str, rounds: int = 5) -> DataFrame:
    """(exp, i, sky): the median of the fibers whose median level is not clipped."""
    levels = spectra.groupBy(exp, fiber).agg(median(F.col(flux)).alias("__level"))
    kept = sigma_clip(levels, [exp], "__level", 3.0, rounds=rounds, out="__c").where("__c is not null").select(exp, fiber)
    return spectra.join(kept, [exp, fiber], "left_semi").groupBy(exp, i).agg(median(F.col(flux)).alias("sky"))


def clip_stats(df: DataFrame, keys: Sequence[str], *columns: str, rounds: int = 5) -> DataFrame:
    """By keys: the median and 1.4826 MAD of each column after clipping, and how many were kept: astrometric residuals."""
    out = df.select(*keys).distinct()
    for c in columns:
        rows = sigma_clip(df, keys, c, 3.0, rounds=rounds, out="__c")
        stats = mad_std(rows, keys, "__c", out=f"{c}_std").join(rows.groupBy(*keys).agg(median(F.col("__c")).alias(f"{c}_median"), F.count("__c").alias(f"{c}_kept")), list(keys))
        out = out.join(stats, list(keys))
    return out


def amp_colour(levels: DataFrame, exp: str, amp: str, x: str, y: str, value: str, sky: str) -> DataFrame:
    """(amp, factor): 1 less the biweight over exposures of what the plane of amp colours (value / sky) over the field leaves."""
    rows = levels.withColumn("__colour", F.try_divide(value, sky))
    rows = plane_fit(rows, [exp], x, y, "__colour", clip=None, rounds=1, out="__plane").withColumn("__left", F.col("__colour") - F.col("__plane"))
    return biweight(rows, [amp], "__left", loc="__loc", scale=None).select(amp, (1 - F.col("__loc")).alias("factor"))


def count_template(spectra: DataFrame, keys: Sequence[str], wave: str, tie: Sequence[str], values: Sequence[str], n: int = 3000) -> DataFrame:
    """(keys, bin, wave, values): mean wavelength and biweights of bins of equal counts along the wavelength."""
    bins = spectra.withColumn("bin", F.ntile(n).over(Window.partitionBy(*keys).orderBy(wave, *tie)))
    out = bins.groupBy(*keys, "bin").agg(F.avg(wave).alias(wave))
    for v in values:
        out = out.join(biweight(bins, [*keys, "bin"], v, loc=v, scale=None), [*keys, "bin"])
    return out


def at_wavelengths(spectra: DataFrame, knots: DataFrame, keys: Sequence[str], wave: str, values: Sequence[str], mark: str = "__t") -> DataFrame:
    """spectra with the knots' values interpolated at their wavelengths, NULL outside, in columns named mark + value."""
    k = F.struct(F.col(wave).cast("double").alias("w"), *[F.col(v).cast("double").alias(v) for v in values])
    a = spectra.withColumn("__w", F.col(wave).cast("double")).withColumn("__k", F.lit(None).cast(knots.select(k.alias("k")).schema["k"].dataType))
    b = knots.select(*keys, F.col(wave).cast("double").alias("__w"), k.alias("__k")).withColumn("__knot", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("__w").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # looked at from the end: a frame that runs to the last row would be gone through again for every row
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__w")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("__a", F.last("__k", True).over(past)).withColumn("__b", F.last("__k", True).over(ahead)).where("__knot is null")
    share = F.coalesce(F.try_divide(F.col("__w") - F.col("__a.w"), F.col("__b.w") - F.col("__a.w")), F.lit(0.0))
    return rows.select(*spectra.columns, *[(F.col(f"__a.{v}") + (F.col(f"__b.{v}") - F.col(f"__a.{v}")) * share).alias(f"{mark}{v}") for v in values])


def fiber_to_fiber(spectra: DataFrame, keys: Sequence[str], fiber: str, i: str, wave: str, flat: str, science: str, twilight: str, n: int = 3000, bins: tuple[int, int] = (5, 25)) -> DataFrame:
    """Adds ftf: each fiber's flat over the average flat at its wavelengths, corrected by two smooth ratios to the twilight."""
    own = [*keys, fiber]
    knots = count_template(spectra, keys, wave, [fiber, i], [flat, science, twilight], n)
    rows = cut(at_wavelengths(spectra, knots, keys, wave, [flat, science, twilight]))
    rows = rows.withColumn("__f", F.try_divide(flat, f"__t{flat}")).withColumn("__z0", F.try_divide(F.try_divide(twilight, f"__t{twilight}"), "__f"))
    rows = cut(continuum(rows, own, i, "__z0", bins[0], "__z"))
    rows = rows.withColumn("__sky", F.col(f"__t{twilight}") * F.col("__f") * F.col("__z")).withColumn("__r0", F.try_divide(F.col(twilight) - F.col("__sky"), F.col("__sky")))
    rows = continuum(rows, own, i, "__r0", bins[1], "__zr")
    return rows.withColumn("ftf", F.col("__f") * F.col("__z") * (1 + F.col("__zr"))).select(*spectra.columns, "ftf")


def fiber_norm(spectra: DataFrame, keys: Sequence[str], fiber: str, i: str, flux: str, bins: int = 51, out: str = "norm") -> DataFrame:
    """Adds the smooth ratio of a fiber to the biweight of all: biweights of runs of the ratio, joined by lines."""
    average = biweight(spectra, [*keys, i], flux, loc="__avg", scale=None)
    rows = spectra.join(average, [*keys, i]).withColumn("__ratio", F.try_divide(flux, "__avg"))
    return continuum(rows, [*keys, fiber], i, "__ratio", bins, out).select(*spectra.columns, out)


def chunk_norm(spectra: DataFrame, keys: Sequence[str], fiber: str, i: str, flux: str, n: int = 100) -> DataFrame:
    """(keys, fiber, chunk, norm): the biweight, by run of bins, of a fiber relative to the biweight of all fibers."""
    average = biweight(spectra, [*keys, i], flux, loc="__avg", scale=None)
    rows = chunk(spectra.join(average, [*keys, i]).withColumn("__ratio", F.try_divide(flux, "__avg")), [*keys, fiber], i, n, "chunk")
    return biweight(rows, [*keys, fiber, "chunk"], "__ratio", loc="norm", scale=None)


def collapsed_flags(spectra: DataFrame, keys: Sequence[str], exp: str, fiber: str, i: str, flux: str, average: str, most: float = 0.2) -> DataFrame:
    """(keys, exp, fiber, flagged): fibers whose biweight over the average residual is above `most`, and their neighbours."""
    rows = spectra.withColumn("__d", F.col(flux) - F.col(average))
    level = biweight(rows, [*keys, exp, fiber], "__d", loc="__level", scale=None).withColumn("__hot", F.coalesce(F.col("__level") > most, F.lit(False)))
    return dilate(level, [*keys, exp], fiber, "__hot", 1, "flagged").select(*keys, exp, fiber, "flagged")


def smooth_continuum(spectra: DataFrame, keys: Sequence[str], i: str, flux: str, kernel: Sequence[float], rounds: int = 6, n_sigma: float = 3.0) -> DataFrame:
    """Adds continuum and outlier: in turns, outliers from the smooth level and their neighbours are left out of the next smoothing."""
    now = spectra.withColumn("__y", F.col(flux).cast("double"))
    for n in range(rounds):
        # where all within the kernel is left out, the level is carried over in a line
        now = interpolate_masked(smooth(now, keys, i, "__y", kernel, "__level"), keys, i, "__level", "continuum").drop("__level")
        now = now.withColumn("__r", F.col(flux) - F.col("continuum"))
        now = sigma_clip(now, keys, "__r", n_sigma, rounds=3, out="__c").withColumn("outlier", F.coalesce(F.col("__c").isNull() & F.col("__r").isNotNull(), F.lit(False)))
        if n < rounds - 1:
            now = dilate(now, keys, i, "outlier", 1, "__m")
            now = cut(now.withColumn("__y", F.when(~F.col("__m"), F.col(flux))).drop("continuum", "outlier", "__m", "__r", "__c"))
    return now.select(*spectra.columns, "continuum", "outlier")


def spectral_mask(
    spectra: DataFrame, amp: str, fiber: str, i: str, value: str, clip: float = 50.0, far: float = 10.0, most_row: int = 200, most_column: int = 30, n_sigma: float = 5.0
) -> DataFrame:
    """Adds masked: values standardised by fiber and then by column of the amp; those far off, fibers and columns with too many of them, and columns whose sum is off.

    Sums are over an amp's n fibers, and off if above n_sigma * sqrt(n).
    """
    by_row, by_column = Window.partitionBy(amp, fiber), Window.partitionBy(amp, i)

    def standard(rows: DataFrame, w: Window, x: str) -> DataFrame:
        rows = rows.withColumn("__d", F.col(x) - median(F.col(x)).over(w))
        return rows.withColumn("__z", F.try_divide(F.col("__d"), median(F.abs("__d")).over(w) * MAD_TO_SIGMA))

    rows = standard(standard(spectra, by_row, value), by_column, "__z")
    rows = rows.withColumn("__z", F.least(F.greatest("__z", F.lit(-clip)), F.lit(clip)))
    rows = rows.withColumn("__bad", F.coalesce(F.abs("__z") > far, F.lit(True)).cast("int"))
    rows = rows.withColumn("__bad", F.when(F.sum("__bad").over(by_row) > most_row, 1).otherwise(F.col("__bad")))
    rows = rows.withColumn("__bad", F.when(F.sum("__bad").over(by_column) > most_column, 1).otherwise(F.col("__bad")))
    total, n = F.sum(F.when(F.col("__bad") == 0, F.col("__z"))).over(by_column), F.count(F.when(F.col("__bad") == 0, 1)).over(by_column)
    off = F.coalesce(F.abs(total) > n_sigma * F.sqrt(n), F.lit(False))
    return rows.withColumn("masked", (F.col("__bad") == 1) | off).select(*spectra.columns, "masked")


def two_round_sky(
    spectra: DataFrame, exp: str, amp: str, fiber: str, i: str, flux: str, sky: str, low: int, high: int, sigma: float = 7.0, reach: int = 14, most_missing: int = 200, least: int = 16
) -> DataFrame:
    """Adds skysub: flux without its sky and without what sky fibers have left of it, smoothed in two dimensions by amp, in two rounds.

    In each round the sky fibers are those whose level in bins [low, high) is the
    mode's; of the rest of each bin the outer two percent are left out; amps with
    fewer than `least` sky fibers are smoothed by nothing.
    """
    bins = [exp, i]
    missing = spectra.groupBy(exp, fiber).agg(F.count(F.when(F.col(flux).isNull(), 1)).alias("__missing"))
    now = spectra.withColumn("__d", F.col(flux) - F.col(sky))
    for n in range(2):
        levels = biweight(now.where(F.col(i).between(low, high - 1)), [exp, fiber], "__d", loc="__level", scale=None)
        good = sky_fibers(levels, [exp], "__level", out="__sky").join(missing, [exp, fiber]).select(exp, fiber, (F.col("__sky") & (F.col("__missing") < most_missing)).alias("__good"))
        rows = percentile_clip(now, bins, "__d", out="__clip").join(good, [exp, fiber]).withColumn("__clip", F.when(F.col("__good"), F.col("__clip")))
        enough = rows.where("__good").select(exp, amp, fiber).distinct().groupBy(exp, amp).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(exp, amp)
        image = rows.join(enough, [exp, amp], "left_semi").select(exp, amp, F.col(i).alias("px"), F.col(fiber).alias("py"), "__clip")
        model = smooth_2d(image, [exp, amp], "__clip", sigma, reach, out="__m").select(exp, amp, F.col("px").alias(i), F.col("py").alias(fiber), "__m")
        now = now.join(model, [exp, amp, fiber, i], "left").withColumn("__d", F.col("__d") - F.coalesce("__m", F.lit(0.0))).drop("__m")
        now = cut(now) if n == 0 else now
    return now.withColumnRenamed("__d", "skysub").select(*spectra.columns, "skysub")


def modelled_sky(spectra: DataFrame, mean: DataFrame, basis: DataFrame, exp: str, i: str, flux: str, k: int) -> DataFrame:
    """Adds sky: an exposure's scale of the mean sky(i, sky) plus the projection of what is left on k components basis(i, b0 ..)."""
    rows = spectra.join(mean.select(i, F.col("sky").alias("__sky")), i)
    scale = template_scale(rows, [exp], flux, "__sky").withColumnRenamed("scale", "__scale")
    rows = rows.join(scale, exp).withColumn("__base", F.col("__scale") * F.col("__sky")).withColumn("__left", F.col(flux) - F.col("__base"))
    rows = low_rank_projection(rows, basis, [exp], i, "__left", k, out="__model")
    return rows.withColumn("sky", F.col("__base") + F.coalesce("__model", F.lit(0.0))).select(*spectra.columns, "sky")


def ratio_fit(df: DataFrame, keys: Sequence[str], x: str, template: str, y: str, rounds: int = 5, limit: float = 4.685, out: str = "model") -> DataFrame:
    """Adds P(x) * template + Q(x), both quadratics, fitted to y by keys with Tukey weights in fixed rounds."""
    terms = [p * F.col(template) for p in powers(F.col(x), 2)] + powers(F.col(x), 2)
    w, now = Window.partitionBy(*keys), cut(df.withColumn("__w", F.lit(1.0)))
    for _ in range(rounds):
        fit = linear_fit(now, keys, terms, F.col(y), F.col("__w")).select(*keys, F.col("coef").alias("__coef"))
        now = cut(now.drop(out).join(fit, list(keys), "left").withColumn(out, evaluate(F.col("__coef"), terms)).drop("__coef"))
        now = now.withColumn("__r", F.col(y) - F.col(out)).withColumn("__s", median(F.abs("__r")).over(w) * MAD_TO_SIGMA)
        u = F.abs(F.try_divide(F.col("__r"), F.col("__s")))
        now = now.withColumn("__w", F.coalesce(F.when(u < limit, F.pow(1 - F.pow(u / limit, 2), 2)).otherwise(0.0), F.lit(1.0))).drop("__r", "__s")
    return now.select(*df.columns, out)


def refit_matches(matches: DataFrame, keys: Sequence[str], x: str, y: str, degree: int = 4, n_sigma: float = 3.0) -> DataFrame:
    """Adds model and kept: matched lines off their polynomial by more than n_sigma * 1.4826 MAD are left out of a second fit."""
    rows = poly_fit(matches, keys, x, y, degree, out="__m").withColumn("__r", F.col(y) - F.col("__m"))
    rows = rows.withColumn("kept", F.abs("__r") <= n_sigma * MAD_TO_SIGMA * median(F.abs("__r")).over(Window.partitionBy(*keys)))
    rows = rows.withColumn("__y", F.when(F.col("kept"), F.col(y)))
    return poly_fit(rows, keys, x, "__y", degree, out="model").select(*matches.columns, "model", "kept")
