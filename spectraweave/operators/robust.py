"""Robust statistics by group: biweight, MAD, clipping, the sky-fiber rule.

All skip NULL; callers turn NaN and sentinels to NULL at ingest. Group statistics
are windows over one set of keys followed by an aggregate over the same keys, so
that the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

MAD_TO_SIGMA = 1.4826


def median(x: Column | str) -> Column:
    """The exact median, the mean of the two middle values for an even count."""
    return F.percentile(x, 0.5)


def null_bad(x: Column, sentinel: float = -999.0) -> Column:
    """NaN and values at or below the sentinel become NULL."""
    return F.when(~F.isnan(x) & (x > sentinel), x)


def with_deviation(df: DataFrame, keys: Sequence[str], x: str, times: str | None = None) -> DataFrame:
    """Adds __m (group median), __d (deviation from it) and __mad (its median size); times: how many rows a row stands for."""
    w = Window.partitionBy(*keys)
    n = F.lit(1) if times is None else F.col(times)
    out = df.withColumn("__m", F.percentile(F.col(x), 0.5, n).over(w)).withColumn("__d", F.col(x) - F.col("__m"))
    return out.withColumn("__mad", F.percentile(F.abs("__d"), 0.5, n).over(w))


def _weights(c: float) -> tuple[Column, Column]:
    u2 = F.pow(F.try_divide(F.col("__d"), c * F.col("__mad")), 2)
    inside = u2 < 1
    return u2, inside


def biweight(df: DataFrame, keys: Sequence[str], x: str, c: float = 9.0, loc: str = "location", scale: str | None = "scale", times: str | None = None) -> DataFrame:
    """Biweight location and scale of x by keys; a MAD of 0 gives the median and a NULL scale; times: how many rows a row stands for."""
    return biweight_of(with_deviation(df, keys, x, times), keys, c, loc, scale, times)


def biweight_of(df: DataFrame, keys: Sequence[str], c: float = 9.0, loc: str = "location", scale: str | None = "scale", times: str | None = None) -> DataFrame:
    """biweight of rows that have their __m, __d and __mad already."""
    u2, inside = _weights(c)
    d, w = F.col("__d"), F.pow(1 - u2, 2)
    n = F.lit(1) if times is None else F.col(times)
    sums = df.groupBy(*keys).agg(
        F.first("__m", True).alias("__m"),
        F.sum(F.when(inside, n * d * w)).alias("__dw"),
        F.sum(F.when(inside, n * w)).alias("__w"),
        F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).alias("__n"),
        F.sum(F.when(inside, n * d * d * F.pow(1 - u2, 4))).alias("__top"),
        F.abs(F.sum(F.when(inside, n * (1 - u2) * (1 - 5 * u2)))).alias("__bottom"),
    )
    out = [*keys, (F.col("__m") + F.coalesce(F.try_divide("__dw", "__w"), F.lit(0.0))).alias(loc)]
    if scale:
        out.append(F.try_divide(F.sqrt(F.col("__n") * F.col("__top")), F.col("__bottom")).alias(scale))
    return sums.select(*out)


def mad_std(df: DataFrame, keys: Sequence[str], x: str, out: str = "mad_std") -> DataFrame:
    """1.4826 times the median deviation from the median, by keys."""
    return with_deviation(df, keys, x).groupBy(*keys).agg((F.first("__mad", True) * MAD_TO_SIGMA).alias(out))


def medians(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """Medians by keys: out=column pairs."""
    return df.groupBy(*keys).agg(*[median(F.col(c)).alias(k) for k, c in columns.items()])


def percentile_clip(df: DataFrame, keys: Sequence[str], x: str, low: float = 0.02, high: float = 0.98, out: str = "clipped") -> DataFrame:
    """Adds x, NULL outside of the group's two percentiles."""
    w = Window.partitionBy(*keys)
    p = F.percentile(F.col(x), F.array(F.lit(low), F.lit(high))).over(w)
    return df.withColumn("__p", p).withColumn(out, F.when(F.col(x).between(F.col("__p")[0], F.col("__p")[1]), F.col(x))).drop("__p")


def sigma_clip(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    low: float = 3.0,
    high: float | None = None,
    rounds: int = 3,
    scale: str = "mad",
    out: str = "clipped",
) -> DataFrame:
    """Adds x, NULL where a round put it beyond low (high) scales from the median of what was left.

    scale is `mad` (1.4826 MAD) or `std` (population). All rounds are windows on
    one partitioning. A group whose scale is 0 loses only what differs from its median.
    """
    w = Window.partitionBy(*keys)
    high = low if high is None else high
    now = df.withColumn(out, F.col(x).cast("double"))
    for _ in range(rounds):
        now = now.withColumn("__m", median(F.col(out)).over(w))
        s = median(F.abs(F.col(out) - F.col("__m"))).over(w) * MAD_TO_SIGMA if scale == "mad" else F.stddev_pop(out).over(w)
        now = now.withColumn("__s", s)
        d = F.col(out) - F.col("__m")
        now = now.withColumn(out, F.when((d >= -low * F.col("__s")) & (d <= high * F.col("__s")), F.col(out)))
    return now.drop("__m", "__s")


def sigma_clip_converged(df: DataFrame, keys: Sequence[str], x: str, low: float = 3.0, high: float | None = None, scale: str = "mad", out: str = "clipped") -> DataFrame:
    """sigma_clip with as many rounds as each group needs: until a round takes nothing more out of it.

    After every round the groups that it left alone are done, and only the others go
    on, so that a few slow groups don't cost a pass over all.
    """
    w, done = Window.partitionBy(*keys), None
    active = cut(df.withColumn(out, F.col(x).cast("double")))
    while True:
        rows = sigma_clip(active.withColumnRenamed(out, "__x"), keys, "__x", low, high, 1, scale, out)
        rows = cut(rows.withColumn("__more", F.count("__x").over(w) > F.count(out).over(w)).drop("__x"))
        settled = rows.where("not __more").drop("__more")
        done = settled if done is None else done.unionByName(settled)
        active = rows.where("__more").drop("__more")
        if active.isEmpty():
            return done.select(*df.columns, out)


def sky_fibers(df: DataFrame, keys: Sequence[str], level: str, steps: int = 81, reach: float = 2.0, out: str = "is_sky") -> DataFrame:
    """Adds whether a fiber's level is near its group's mode.

    The mode is the one of `steps` levels between the 5th and 60th percentile
    that has the most values within one biweight scale, the lowest on a tie;
    levels less than `reach` scales above it are sky.
    """
    scales = biweight(df, keys, level, loc="__loc", scale="__scale").select(*keys, "__scale")
    # the fibers of an exposure are as many as the instrument has: one sorted array, and two searches for each level
    values = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(level).cast("double"))).alias("__v"), F.percentile(level, F.array(F.lit(0.05), F.lit(0.6))).alias("__p"))

    def densest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = []
            for v, p, scale in zip(b["__v"], b["__p"], b["__scale"]):
                if p is None or pd.isna(scale):
                    at.append(None)
                    continue
                grid = p[0] + (p[1] - p[0]) * np.arange(steps) / (steps - 1)
                votes = np.searchsorted(v, grid + scale, "left") - np.searchsorted(v, grid - scale, "right")
                at.append(float(grid[votes.argmax()]))
            yield b.drop(columns=["__v", "__p"]).assign(__at=at)

    found = values.join(scales, list(keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name not in ("__v", "__p"))
    mode = found.mapInPandas(densest, f"{schema}, __at double")
    return df.join(mode, list(keys), "left").withColumn(out, F.coalesce(F.col(level) - F.col("__at") < reach * F.col("__scale"), F.lit(False))).drop("__at", "__scale")
