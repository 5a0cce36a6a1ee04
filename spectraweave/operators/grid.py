"""Images and cubes as pixel rows: splatting, mosaics, smoothing, apertures, sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import dealt
from .robust import biweight, mad_std, median, sigma_clip_converged


def grid_setup(spark: SparkSession, size: float, scale: float) -> DataFrame:
    """Pixels (px, py, x, y) of a centered square image: the count is odd, offsets in arcseconds."""
    n = int(size / scale)
    n += 1 - n % 2
    half = n // 2
    ids = spark.range(n * n)
    px, py = F.floor(F.col("id") % n), F.floor(F.col("id") / n)
    return ids.select(px.alias("px"), py.alias("py"), ((px - half) * scale).alias("x"), ((py - half) * scale).alias("y"))


def splat(points: DataFrame, keys: Sequence[str], x: str, y: str, value: str, sigma: float, reach: int, least: float = 0.8) -> DataFrame:
    """Image by keys: each point gives its value with a Gaussian stamp of unit sum; pixels of under `least` of the largest weight go."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    cells = points.where(F.col(value).isNotNull()).withColumn("__s", F.explode(steps))
    cells = cells.withColumn("px", F.round(x).cast("long") + F.col("__s.a")).withColumn("py", F.round(y).cast("long") + F.col("__s.b"))
    r2 = F.pow(F.col("px") - F.col(x), 2) + F.pow(F.col("py") - F.col(y), 2)
    cells = cells.withColumn("__w", F.exp(-0.5 * r2 / sigma**2) / (2 * math.pi * sigma**2))
    image = cells.groupBy(*keys, "px", "py").agg(F.sum(F.col("__w") * F.col(value)).alias("__v"), F.sum("__w").alias("weight"))
    top = image.groupBy(*keys).agg(F.max("weight").alias("__top")) if keys else image.agg(F.max("weight").alias("__top"))
    both = image.join(top, list(keys)) if keys else image.crossJoin(F.broadcast(top))
    return both.where(F.col("weight") >= least * F.col("__top")).select(*keys, "px", "py", F.try_divide("__v", "weight").alias(value), "weight")


def median_mosaic(points: DataFrame, keys: Sequence[str], shot: str, order: str, x: str, y: str, value: str, area: float = 1.0, error: str | None = None) -> DataFrame:
    """Median over shots of each pixel, per unit area; within a shot a later point (by order) takes a pixel from an earlier.

    The variance scales with 1 / area^2 and averages over shots. One job for all
    keys: with a wavelength number among them this is the cube.
    """
    cells = points.where(F.col(value).isNotNull()).withColumn("px", F.round(x).cast("long")).withColumn("py", F.round(y).cast("long"))
    packed = F.struct(F.col(value).alias("v"), (F.col(error) if error else F.lit(None).cast("double")).alias("e"))
    own = cells.groupBy(*keys, shot, "px", "py").agg(F.max_by(packed, order).alias("__p"))
    out = own.groupBy(*keys, "px", "py").agg(
        (median(F.col("__p.v")) / area).alias(value), F.count("*").alias("coverage"), (F.sqrt(F.sum(F.pow("__p.e", 2))) / F.count("__p.e") / area).alias("error")
    )
    return out if error else out.drop("error")


def smooth_2d(image: DataFrame, keys: Sequence[str], value: str, sigma: float, reach: int, variance: bool = False, out: str = "smoothed") -> DataFrame:
    """(keys, px, py, out) for the pixels present: a Gaussian mean over those present; variance: of independent variances, by squared weights.

    The Gaussian is the product of one along each axis, so sums are taken along
    px, then along py, each on rows dealt by the other axis: a pixel is shuffled
    once for each, and copied along one axis at a time.
    """
    weights = [(a, math.exp(-0.5 * a * a / sigma**2)) for a in range(-reach, reach + 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(w).alias("w"), F.lit(w * w if variance else w).alias("v")) for a, w in weights]))
    sums = image.where(F.col(value).isNotNull()).select(*keys, "px", "py", F.col(value).alias("__v"), F.lit(1.0).alias("__w"))
    for along, other in (("px", "py"), ("py", "px")):
        spread = dealt(sums, *keys, other).select(*keys, along, other, "__v", "__w", steps.alias("s"))
        spread = spread.withColumn(along, F.col(along) + F.col("s.a"))
        sums = spread.groupBy(*keys, "px", "py").agg(F.sum(F.col("__v") * F.col("s.v")).alias("__v"), F.sum(F.col("__w") * F.col("s.w")).alias("__w"))
    sums = sums.select(*keys, "px", "py", (F.col("__v") / (F.pow("__w", 2) if variance else F.col("__w"))).alias(out))
    return image.select(*keys, "px", "py").join(sums, [*keys, "px", "py"], "left")


def aperture_sum(image: DataFrame, apertures: DataFrame, ap_id: str, value: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Sum and count of the pixels whose centers are within `radius` pixels of each aperture."""
    r = int(math.ceil(radius))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1)])
    cells = apertures.select(ap_id, F.col(x).alias("__x"), F.col(y).alias("__y"), F.explode(steps).alias("s"))
    cells = cells.withColumn("px", F.round("__x").cast("long") + F.col("s.a")).withColumn("py", F.round("__y").cast("long") + F.col("s.b"))
    inside = cells.where(F.pow(F.col("px") - F.col("__x"), 2) + F.pow(F.col("py") - F.col("__y"), 2) <= radius * radius)
    return inside.join(image.select("px", "py", value), ["px", "py"]).groupBy(ap_id).agg(F.sum(value).alias("total"), F.count(value).alias("n_pixels"))


def find_sources(image: DataFrame, keys: Sequence[str], value: str, threshold: Column, reach: int = 1) -> DataFrame:
    """Pixels above the threshold that are largest of their block, with the block's centroid; equal neighbours: the first."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    spread = image.select(*keys, F.col("px").alias("__x"), F.col("py").alias("__y"), F.col(value).alias("__v"), F.explode(steps).alias("s"))
    spread = spread.select(*keys, (F.col("__x") + F.col("s.a")).alias("px"), (F.col("__y") + F.col("s.b")).alias("py"), "__x", "__y", "__v")
    pos = F.greatest(F.col("__v"), F.lit(0.0))
    block = spread.groupBy(*keys, "px", "py").agg(
        F.min(F.struct((-F.col("__v")).alias("v"), F.col("__x").alias("x"), F.col("__y").alias("y"))).alias("__top"),
        F.try_divide(F.sum(pos * F.col("__x")), F.sum(pos)).alias("x"),
        F.try_divide(F.sum(pos * F.col("__y")), F.sum(pos)).alias("y"),
    )
    found = image.where(threshold).join(block, [*keys, "px", "py"])
    return found.where((F.col("__top.x") == F.col("px")) & (F.col("__top.y") == F.col("py"))).select(*keys, "px", "py", value, "x", "y")


def weighted_image(points: DataFrame, keys: Sequence[str], x: str, y: str, value: str, sigma: float, radius: float) -> DataFrame:
    """Kernel-weighted mean of the points within `radius` of each pixel that has any."""
    r = int(math.ceil(radius))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-r, r + 1) for b in range(-r, r + 1)])
    cells = points.where(F.col(value).isNotNull()).withColumn("__s", F.explode(steps))
    cells = cells.withColumn("px", F.round(x).cast("long") + F.col("__s.a")).withColumn("py", F.round(y).cast("long") + F.col("__s.b"))
    r2 = F.pow(F.col("px") - F.col(x), 2) + F.pow(F.col("py") - F.col(y), 2)
    cells = cells.withColumn("__r2", r2).where(F.col("__r2") <= radius * radius).withColumn("__w", F.exp(-0.5 * F.col("__r2") / sigma**2))
    return cells.groupBy(*keys, "px", "py").agg((F.sum(F.col("__w") * F.col(value)) / F.sum("__w")).alias(value), F.count("*").alias("n"))


def mosaic_tiles(tiles: DataFrame, inner: int, edge: int) -> DataFrame:
    """One image from tiles (tile_x, tile_y, px, py): the inner cells, shifted to their tile's place."""
    kept = tiles.where(F.col("px").between(edge, edge + inner - 1) & F.col("py").between(edge, edge + inner - 1))
    return kept.withColumn("px", F.col("tile_x") * inner + F.col("px") - edge).withColumn("py", F.col("tile_y") * inner + F.col("py") - edge).drop("tile_x", "tile_y")


def cube_stats(voxels: DataFrame, flux: str, error: str, least: int = 1, share: float = 0.8) -> DataFrame:
    """By spaxel: covered share of bins, median continuum, MAD and three percentiles of S/N, for spaxels with `least` bins."""
    whole = voxels.agg(F.count_distinct("wave_idx").alias("__bins"))
    sn = voxels.withColumn("__sn", F.try_divide(F.col(flux), F.col(error)))
    w = Window.partitionBy("x", "y")
    sn = sn.withColumn("__d", F.abs(F.col("__sn") - median(F.col("__sn")).over(w)))
    out = sn.groupBy("x", "y").agg(
        F.count("__sn").alias("n"), median(F.col(flux)).alias("continuum"), (median(F.col("__d")) * 1.4826).alias("sn_mad"), F.percentile("__sn", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("__p")
    )
    out = out.where(F.col("n") >= least).crossJoin(F.broadcast(whole))
    covered = F.col("n") / F.col("__bins")
    return out.select("x", "y", "n", covered.alias("coverage"), (covered >= share).alias("covered"), "continuum", "sn_mad", *[F.col("__p")[k].alias(f"sn_p{p}") for k, p in enumerate((16, 50, 84))])


def clipped_stats(voxels: DataFrame, flux: str, error: str, n_sigma: float = 5.0, cell: Sequence[str] = ("x", "y")) -> DataFrame:
    """By spaxel: how many bins are left after clipping S/N at n_sigma * 1.4826 MAD until nothing more goes, their biweight and their MAD deviation."""
    rows = sigma_clip_converged(voxels.withColumn("__sn", F.try_divide(F.col(flux), F.col(error))), cell, "__sn", n_sigma, out="__kept")
    counts = rows.groupBy(*cell).agg(F.count("__kept").alias("n_kept"))
    level = biweight(rows, list(cell), "__kept", loc="sn_location", scale=None)
    return counts.join(level, list(cell), "left").join(mad_std(rows, list(cell), "__kept", out="sn_mad"), list(cell), "left")
