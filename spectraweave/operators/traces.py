"""From frames to traces: where on the detector each fiber's light runs.

Columns are cut into chunks, each chunk gives a profile across the fibers, its
peaks are dealt to the fibers in their order, and each fiber's peaks are joined by
a polynomial along the columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fits import poly_fit
from .lineage import cut, dealt, few
from .robust import MAD_TO_SIGMA, median
from .windows import ordered, running_percentile, smooth


def gaussian_kernel(sigma: float) -> list[float]:
    """An odd kernel of a Gaussian, out to four sigma, of unit sum."""
    half = math.ceil(4 * sigma)
    k = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-half, half + 1)]
    return [x / sum(k) for x in k]


def even_chunk(i: Column, n: Column, chunks: int) -> Column:
    """The number of the chunk that place i of 0 .. n-1 is in, the first n % chunks chunks being one longer."""
    q, r = F.floor(n / chunks), n % chunks
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")


def chunk_profiles(frame: DataFrame, keys: Sequence[str], value: str, chunks: int = 40) -> DataFrame:
    """(keys, chunk, at, row, value): the median of each row within each chunk of columns; at: the chunk's mean column.

    frame: keys, row, col and the value. Frames may differ in their numbers of columns.
    """
    wide = frame.groupBy(*keys).agg((F.max("col") + 1).alias("__n"))
    rows = frame.join(few(wide), list(keys)).withColumn("chunk", even_chunk(F.col("col"), F.col("__n"), chunks))
    return rows.groupBy(*keys, "chunk", "row").agg(F.avg("col").alias("at"), median(F.col(value)).alias(value))


def without_pedestal(profiles: DataFrame, keys: Sequence[str], value: str, window: int = 201, p: float = 0.05, degree: int = 2, sigma: float = 1.5, out: str = "clean") -> DataFrame:
    """Adds the profile less its pedestal, smoothed: a polynomial through the running low percentile, then a Gaussian kernel."""
    rows = cut(running_percentile(dealt(profiles, *keys), keys, "row", value, window, p, "__low"))  # the fit reads it three times
    rows = poly_fit(rows, keys, "row", "__low", degree, out="__base").withColumn("__c", F.col(value) - F.coalesce("__base", F.lit(0.0)))
    return smooth(rows, keys, "row", "__c", gaussian_kernel(sigma), out).select(*profiles.columns, out)


def profile_peaks(profiles: DataFrame, keys: Sequence[str], value: str, clean: str, most: DataFrame, per: Sequence[str]) -> DataFrame:
    """(keys, at, row, height, peak): the highest peaks of the clean profile, with a place to a part of a row from the profile itself.

    most(per, n_good, n_all): how many fibers should have light, and are there. The
    n_good highest peaks are kept; n_all, if so many are at least half as high as
    the middle one of the good.
    """
    w = ordered(keys, "row")
    a, b, y = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    up, down = F.col(clean) > F.lag(clean).over(w), F.col(clean) > F.lead(clean).over(w)
    at = F.col("row") - F.try_divide(b - a, 2 * (b - 2 * y + a))
    rows = profiles.withColumn("__up", up & down).withColumn("peak", at).where("__up").withColumn("height", F.col(clean))
    whole = Window.partitionBy(*keys)
    rows = rows.join(few(most), list(per)).withColumn("__r", F.row_number().over(whole.orderBy(F.desc("height"), "row")))
    rows = rows.withColumn("__mid", F.max(F.when(F.col("__r") == F.ceil(F.col("n_good") / 2), F.col("height"))).over(whole))
    rows = rows.withColumn("__high", F.count(F.when((F.col("__r") <= F.col("n_all")) & (F.col("height") >= F.col("__mid") / 2), 1)).over(whole))
    kept = F.when(F.col("__high") >= F.col("n_all"), F.col("n_all")).otherwise(F.col("n_good"))
    return rows.where(F.col("__r") <= kept).select(*keys, "at", "row", "height", "peak")


def expected(locations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_good, n_all): how many fibers of a location table have light, and are there."""
    return locations.groupBy(*keys).agg(F.count(F.when(F.col("dead") == 0, 1)).alias("n_good"), F.count("*").alias("n_all"))


def fiber_peaks(peaks: DataFrame, locations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, chunk, at, fiber, trace, filled): peaks dealt to fibers in their order.

    locations: keys, fiber, position and dead. Where a chunk has a peak for each
    fiber with light, its k-th peak is the k-th of these; where it has one for each
    fiber at all, the dead ones were found alive. Other chunks have no peaks. A dead
    fiber takes the nearest good fiber's place (of two the lower), moved by the
    difference of their positions.
    """
    w, here = Window.partitionBy(*keys), Window.partitionBy(*keys, "chunk")
    lit = F.when(F.col("dead") == 0, F.col("fiber"))
    every = locations.withColumn("__n_all", F.count("*").over(w)).withColumn("__n_good", F.count(lit).over(w))
    line = w.orderBy("fiber")
    good = every.where("dead = 0").select(*keys, "fiber", "__n_good", F.lit("good").alias("__kind"), F.row_number().over(line).alias("__k"))
    whole = every.where("__n_all > __n_good").select(*keys, "fiber", "__n_all", F.lit("all").alias("__kind"), F.row_number().over(line).alias("__k"))
    ranks = good.withColumnRenamed("__n_good", "__n").unionByName(whole.withColumnRenamed("__n_all", "__n"))
    peaks = cut(peaks)  # read once for the good fibers and once for the dead
    found = peaks.withColumn("__k", F.row_number().over(here.orderBy("row"))).withColumn("__n", F.count("*").over(here))
    # both sides follow the fibers, so neither is to be broadcast
    seen = found.join(ranks.hint("shuffle_hash"), [*keys, "__n", "__k"])
    # a dead fiber's nearest good one
    place = F.when(F.col("dead") == 0, F.struct("fiber", "position"))
    near = every.withColumn("__a", F.last(place, True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # from the end: a frame that runs to the last fiber would be gone through again for every fiber
    near = near.withColumn("__b", F.last(place, True).over(w.orderBy(F.desc("fiber")).rowsBetween(Window.unboundedPreceding, 0))).where("dead <> 0")
    lower = F.coalesce(F.col("fiber") - F.col("__a.fiber") <= F.col("__b.fiber") - F.col("fiber"), F.col("__b").isNull())
    from_ = F.when(lower, F.col("__a")).otherwise(F.col("__b"))
    near = near.select(*keys, F.col("fiber").alias("__dead"), from_["fiber"].alias("fiber"), (F.col("position") - from_["position"]).alias("__off"))
    filled = seen.where("__kind = 'good'").join(near.hint("shuffle_hash"), [*keys, "fiber"])
    kept = seen.select(*keys, "chunk", "at", "fiber", F.col("peak").alias("trace"), F.lit(False).alias("filled"))
    return kept.unionByName(filled.select(*keys, "chunk", "at", F.col("__dead").alias("fiber"), (F.col("peak") + F.col("__off")).alias("trace"), F.lit(True).alias("filled")))


def huber(x: np.ndarray, y: np.ndarray, degree: int, rounds: int, limit: float = 1.35) -> np.ndarray | None:
    """Coefficients of a polynomial by weights 1, then limit / |residual| beyond limit robust sigmas, in fixed rounds; None for too few points."""
    if len(np.unique(x)) <= degree:
        return None
    terms, w = np.vander(x, degree + 1, increasing=True), np.ones(len(x))
    for _ in range(rounds):
        coef = np.linalg.lstsq(terms * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = np.abs(y - terms @ coef)
        scale = np.median(r) * MAD_TO_SIGMA
        if not scale:
            break
        w = limit / np.maximum(r / scale, limit)
    return coef


def curves(points: DataFrame, keys: Sequence[str], x: str, y: str, at: DataFrame, per: Sequence[str], degree: int = 4, rounds: int = 5, out: str = "trace") -> DataFrame:
    """(keys, col, out): a Huber polynomial through each key's few points, on every column of its frame.

    at(per, n): the number of columns. Points are as many as a frame has chunks, so
    that one key's go to a worker as one row. Fewer points than coefficients give a
    polynomial of as high a degree as they allow; a key without points has no rows.
    """
    packed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(x).cast("double")).alias("__x"), F.collect_list(F.col(y).cast("double")).alias("__y"))
    packed = packed.join(few(at), list(per))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            values = []
            for xs, ys, n in zip(f["__x"], f["__y"], f["n"]):
                mid, half = (n - 1) / 2, max(1.0, n / 2)
                u = (np.asarray(xs, float) - mid) / half
                coef = next(c for d in range(degree, -1, -1) if (c := huber(u, np.asarray(ys, float), d, rounds)) is not None)
                values.append(np.polynomial.polynomial.polyval((np.arange(n) - mid) / half, coef).tolist())
            yield f.drop(columns=["__x", "__y", "n"]).assign(values=values)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name not in ("__x", "__y", "n"))
    fitted = packed.mapInPandas(solve, f"{schema}, values array<double>")
    return fitted.select(*keys, F.posexplode("values").alias("col", out))


def fiber_traces(
    frame: DataFrame, locations: DataFrame, keys: Sequence[str], value: str, chunks: int = 40, window: int = 201, degree: int = 4
) -> DataFrame:
    """(keys, fiber, col, trace): the row of each fiber's center in each column of a flat frame.

    frame: keys, row, col and the value; locations: keys, fiber, position and dead.
    A frame without locations, or of whose chunks none has the right number of
    peaks, has no traces.
    """
    profiles = cut(chunk_profiles(frame, keys, value, chunks))  # a chunk's width smaller than the frame, and read several times
    clean = without_pedestal(profiles, [*keys, "chunk"], value, window)
    peaks = profile_peaks(clean, [*keys, "chunk"], value, "clean", expected(locations, keys), keys)
    columns = frame.groupBy(*keys).agg((F.max("col") + 1).cast("long").alias("n"))
    return curves(fiber_peaks(peaks, locations, keys), [*keys, "fiber"], "at", "trace", columns, keys, degree)
