"""Spectra as arrays and as long rows: the bridge between both, resampling, continuum, extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .robust import biweight
from .windows import chunk, ordered


def to_long(df: DataFrame, keys: Sequence[str], arrays: Sequence[str], i: str = "wave_idx") -> DataFrame:
    """A row for each bin, from arrays of one length."""
    first, *rest = arrays
    rows = df.select(*keys, *rest, F.posexplode(first).alias(i, first))
    return rows.select(*keys, i, first, *[F.get(F.col(c), F.col(i)).alias(c) for c in rest])


def to_array(df: DataFrame, keys: Sequence[str], values: Sequence[str], i: str = "wave_idx") -> DataFrame:
    """The arrays again, in the order of the bins."""
    rows = F.array_sort(F.collect_list(F.struct(i, *values)))
    packed = df.groupBy(*keys).agg(rows.alias("__v"))
    return packed.select(*keys, *[F.col(f"__v.{c}").alias(c) for c in values])


def rectify(df: DataFrame, keys: Sequence[str], x: str, y: str, grid: DataFrame, at: str = "at", error: str | None = None) -> DataFrame:
    """Linear interpolation of (x, y) at each grid place `at`, NULL outside of the samples.

    With error, also the interpolated error: the two sides' errors in quadrature,
    weighted by distance. Samples and places meet in one ordering of each key.
    """
    cols = [y] + ([error] if error else [])
    knot = F.struct(F.col(x).cast("double").alias("x"), *[F.col(c).cast("double").alias(c) for c in cols])
    knots = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.lit(None).cast("double").alias(at), knot.alias("__k"))
    # every key meets every place: that is the result's size; the grid, a lookup table, goes along in one row
    one = grid.agg(F.collect_set(F.col(at).cast("double")).alias("__grid"))
    places = df.select(*keys).distinct().crossJoin(F.broadcast(one)).withColumn(at, F.explode("__grid"))
    places = places.select(*keys, F.col(at).alias("__x"), at, F.lit(None).cast(knots.schema["__k"].dataType).alias("__k"))
    both = knots.unionByName(places)
    w = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    v = Window.partitionBy(*keys).orderBy("__x").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = both.withColumn("__a", F.last("__k", True).over(w)).withColumn("__b", F.first("__k", True).over(v)).where(F.col(at).isNotNull())
    share = F.when(F.col("__b.x") == F.col("__a.x"), 0.0).otherwise(F.try_divide(F.col(at) - F.col("__a.x"), F.col("__b.x") - F.col("__a.x")))
    out = [*keys, at, (F.col(f"__a.{y}") + (F.col(f"__b.{y}") - F.col(f"__a.{y}")) * share).alias(y)]
    if error:
        out.append(F.sqrt(F.pow(F.col(f"__a.{error}") * (1 - share), 2) + F.pow(F.col(f"__b.{error}") * share, 2)).alias(error))
    return rows.select(*out)


def block_rebin(image: DataFrame, keys: Sequence[str], x: str, y: str, value: str, k: int) -> DataFrame:
    """Averages of k x k blocks of pixels."""
    return image.groupBy(*keys, F.floor(F.col(x) / k).alias(x), F.floor(F.col(y) / k).alias(y)).agg(F.avg(value).alias(value))


def continuum(df: DataFrame, keys: Sequence[str], i: str, y: str, bins: int, out: str = "continuum") -> DataFrame:
    """Adds a smooth level: biweights of `bins` runs of samples, joined by lines through the runs' centers.

    Outside of the first and last center the end values are held; a key with no
    more than half its runs measured has a level of 0.
    """
    parts = chunk(df, keys, i, bins, "__chunk")
    centers = parts.groupBy(*keys, "__chunk").agg(F.avg(i).alias("__at"))
    levels = biweight(parts, [*keys, "__chunk"], y, loc="__level", scale=None)
    whole = Window.partitionBy(*keys)
    knots = centers.join(levels, [*keys, "__chunk"]).where("__level is not null").withColumn("__n", F.count("*").over(whole))
    knot = F.struct(F.col("__at").alias("at"), F.col("__level").alias("level"), F.col("__n").alias("n"))
    knots = knots.select(*keys, F.col("__at").alias("__x"), knot.alias("__k"), F.lit(True).alias("__knot"))
    both = df.withColumn("__x", F.col(i).cast("double")).unionByName(knots, allowMissingColumns=True)
    w = whole.orderBy("__x")
    past, ahead = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = both.withColumn("__a", F.last("__k", True).over(past)).withColumn("__b", F.first("__k", True).over(ahead)).where("__knot is null")
    a, b = F.coalesce("__a", "__b"), F.coalesce("__b", "__a")
    share = F.coalesce(F.try_divide(F.col("__x") - a["at"], b["at"] - a["at"]), F.lit(0.0))
    value = a["level"] + (b["level"] - a["level"]) * share
    return rows.withColumn(out, F.when(a["n"] > bins / 2, value).otherwise(0.0)).select(*df.columns, out)


def aperture_extract(frame: DataFrame, trace: DataFrame, keys: Sequence[str], value: str, error: str | None = None, width: int = 5) -> DataFrame:
    """Flux by (fiber, col): frame rows within width/2 of the trace, edge pixels by the share inside, divided by the width.

    frame: keys, row, col, value; trace: keys, fiber, col, trace. A trace whose
    aperture leaves the frame gets 0. Errors add in quadrature with the shares.
    """
    half = width / 2
    size = frame.groupBy(*keys).agg(F.max("row").alias("__last"))
    cells = trace.withColumn("row", F.explode(F.sequence(F.floor(F.col("trace") - half + 0.5).cast("int"), F.floor(F.col("trace") + half + 0.5).cast("int"))))
    share = F.greatest(F.lit(0.0), F.least(F.col("row") + 0.5, F.col("trace") + half) - F.greatest(F.col("row") - 0.5, F.col("trace") - half))
    met = cells.withColumn("__share", share).join(frame, [*keys, "row", "col"], "left").join(size, list(keys))
    inside = (F.min("row") >= 0) & (F.max("row") <= F.first("__last"))
    sums = [F.when(inside, F.sum(F.col(value) * F.col("__share")) / width).otherwise(0.0).alias(value)]
    if error:
        sums.append(F.when(inside, F.sqrt(F.sum(F.pow(F.col(error) * F.col("__share"), 2))) / width).otherwise(0.0).alias(error))
    return met.groupBy(*keys, "fiber", "col").agg(*sums)


def profile_chi2(frame: DataFrame, flat: DataFrame, trace: DataFrame, keys: Sequence[str], value: str, error: str, floor: float = 0.01, offsets: Sequence[int] = (-2, -1, 0, 1, 2)) -> DataFrame:
    """Reduced chi-square by (fiber, col) of the science profile against the flat's, both scaled to sum 1, with a relative error floor."""
    cells = trace.withColumn("row", F.explode(F.array(*[F.round("trace").cast("int") + o for o in offsets])))
    met = cells.join(frame, [*keys, "row", "col"]).join(flat.select(*keys, "row", "col", F.col(value).alias("__flat")), [*keys, "row", "col"])
    w = Window.partitionBy(*keys, "fiber", "col")
    scale = F.try_divide(F.sum(value).over(w), F.sum("__flat").over(w))
    rows = met.withColumn("__model", F.col("__flat") * scale)
    var = F.pow(error, 2) + F.pow(floor * F.col("__model"), 2)
    return rows.groupBy(*keys, "fiber", "col").agg(F.try_divide(F.sum(F.try_divide(F.pow(F.col(value) - F.col("__model"), 2), var)), F.count(value) - 1).alias("chi2"))


def synthetic_mag(spectrum: str, response: str, zero_point: float = 23.9) -> Column:
    """AB magnitude of a spectrum array through a response array, NULL bins skipped; NULL for a mean flux that isn't positive."""
    flux = F.transform(F.sequence(F.lit(0), F.size(spectrum) - 1), lambda i: F.struct(F.get(spectrum, i).alias("f"), F.get(response, i).alias("r")))
    good = F.filter(flux, lambda x: x["f"].isNotNull() & x["r"].isNotNull())
    total = lambda f: F.aggregate(good, F.lit(0.0), lambda s, x: s + f(x))
    mean = F.try_divide(total(lambda x: x["f"] * x["r"]), total(lambda x: x["r"].cast("double")))
    return F.when(mean > 0, -2.5 * F.log10(mean) + zero_point)
