"""Operators over ordered samples: peaks, dilation, running statistics, smoothing, sessions, duplicates.

`keys` part the samples and `i` orders them; each operator shuffles once by the
keys, or not at all where the input is dealt by them already.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .lineage import dealt
from .robust import median


def ordered(keys: Sequence[str], *by: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def local_peaks(df: DataFrame, keys: Sequence[str], i: str, y: str, threshold: float) -> DataFrame:
    """Samples above the threshold that rise from the one before and fall to the next, with a parabola's peak place."""
    w = ordered(keys, i)
    rows = df.withColumn("__a", F.lag(y).over(w)).withColumn("__b", F.lead(y).over(w))
    rows = rows.where((F.col(y) > F.col("__a")) & (F.col(y) > F.col("__b")) & (F.col(y) > threshold))
    at = F.col(i) - (F.col("__b") - F.col("__a")) / (2 * (F.col("__b") - 2 * F.col(y) + F.col("__a")))
    return rows.withColumn("peak", at).drop("__a", "__b")


def local_maxima_3d(voxels: DataFrame, axes: tuple[str, str, str], value: str, threshold: float) -> DataFrame:
    """Voxels above the threshold that are the largest of their 27-cell block; absent cells count as 0.

    Each voxel gives its value to its 27 cells, whose maxima are partly taken
    before the shuffle.
    """
    x, y, z = axes
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = voxels.select(x, y, z, F.col(value).alias("__v"), steps.alias("s")).select(
        (F.col(x) + F.col("s.a")).alias(x), (F.col(y) + F.col("s.b")).alias(y), (F.col(z) + F.col("s.c")).alias(z), "__v"
    )
    highest = spread.groupBy(x, y, z).agg(F.max("__v").alias("__top"))
    found = voxels.where(F.col(value) > threshold).join(highest, [x, y, z])
    return found.where(F.col(value) >= F.greatest("__top", F.lit(0.0))).drop("__top")


def dilate(df: DataFrame, keys: Sequence[str], i: str, mask: str, k: int, out: str = "dilated") -> DataFrame:
    """Adds whether any sample within k places is set."""
    w = ordered(keys, i).rangeBetween(-k, k)
    return df.withColumn(out, F.max(F.col(mask).cast("int")).over(w) == 1)


def running_percentile(df: DataFrame, keys: Sequence[str], i: str, y: str, size: int, p: float = 0.5, out: str = "running") -> DataFrame:
    """Adds the percentile of the `size` samples about each (fewer at the ends)."""
    half = size // 2
    return df.withColumn(out, F.percentile(F.col(y), p).over(ordered(keys, i).rowsBetween(-half, half)))


def smooth(df: DataFrame, keys: Sequence[str], i: str, y: str, kernel: Sequence[float], out: str = "smoothed", error: bool = False) -> DataFrame:
    """Adds y convolved with an odd kernel, renormalised over the samples present; error: sqrt(sum(y^2 k^2)) / sum(k)."""
    half, w = len(kernel) // 2, ordered(keys, i)
    terms = [(k, F.lag(y, half - j).over(w) if j < half else F.lead(y, j - half).over(w) if j > half else F.col(y)) for j, k in enumerate(kernel)]
    weight = sum((F.when(v.isNotNull(), k).otherwise(0.0) for k, v in terms), F.lit(0.0))
    if error:
        total = F.sqrt(sum((F.coalesce(v * v * (k * k), F.lit(0.0)) for k, v in terms), F.lit(0.0)))
    else:
        total = sum((F.coalesce(v * k, F.lit(0.0)) for k, v in terms), F.lit(0.0))
    return df.withColumn(out, F.try_divide(total, weight))


def chunk(df: DataFrame, keys: Sequence[str], i: str, n: int, out: str = "chunk") -> DataFrame:
    """Adds the number, from 0, of one of n near-equal runs of samples; earlier runs take the extra ones."""
    return df.withColumn(out, F.ntile(n).over(ordered(keys, i)) - 1)


def session_groups(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: float, tie: str, out: str = "session") -> DataFrame:
    """Adds a session number, from 0: a new one starts where the gap to the row before exceeds gap_seconds."""
    w = ordered(keys, ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    starts = F.coalesce(((seconds - F.lag(seconds).over(w)) > gap_seconds).cast("int"), F.lit(0))
    return df.withColumn("__new", starts).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def number_groups(df: DataFrame, keys: Sequence[str], number: str, out: str = "block") -> DataFrame:
    """Adds a block number, from 0: a new one starts where the number jumps by more than 1."""
    w = ordered(keys, number)
    jumps = F.coalesce(((F.col(number) - F.lag(number).over(w)) > 1).cast("int"), F.lit(0))
    return df.withColumn("__new", jumps).withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def first_per(df: DataFrame, keys: Sequence[str], *by: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(ordered(keys, *by))).where("__r = 1").drop("__r")


def bin_widths(df: DataFrame, keys: Sequence[str], i: str, x: str, out: str = "width") -> DataFrame:
    """Adds x minus the one before; the first repeats the second's."""
    w = ordered(keys, i)
    return df.withColumn(out, F.coalesce(F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)))


def interpolate_masked(df: DataFrame, keys: Sequence[str], i: str, y: str, out: str = "filled") -> DataFrame:
    """Adds y with NULLs filled linearly between the nearest samples, the end values held."""
    before = ordered(keys, i).rowsBetween(Window.unboundedPreceding, 0)
    after = ordered(keys, i).rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(y).isNotNull(), F.struct(F.col(i).alias("i"), F.col(y).alias("y")))
    rows = df.withColumn("__h", here).withColumn("__a", F.last("__h", True).over(before)).withColumn("__b", F.first("__h", True).over(after))
    share = F.try_divide(F.col(i) - F.col("__a.i"), F.col("__b.i") - F.col("__a.i"))
    mid = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * share
    return rows.withColumn(out, F.coalesce(F.col(y), mid, F.col("__a.y"), F.col("__b.y"))).drop("__h", "__a", "__b")


def suppress_close(df: DataFrame, keys: Sequence[str], x: str, height: str, separation: float, most: int) -> DataFrame:
    """Peaks kept greedily, highest first, each further than `separation` from those kept, at most `most` by key."""
    peak = F.struct((-F.col(height)).alias("h"), F.col(x).alias("x"))
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(peak)).alias("__p"))
    kept = F.aggregate(
        "__p",
        F.array().cast(lists.schema["__p"].dataType),
        lambda got, p: F.when((F.size(got) >= most) | F.exists(got, lambda q: F.abs(q["x"] - p["x"]) <= separation), got).otherwise(F.array_append(got, p)),
    )
    return lists.select(*keys, F.explode(kept).alias("p")).select(*keys, F.col("p.x").alias(x), (-F.col("p.h")).alias(height))


def top_n(df: DataFrame, keys: Sequence[str], n: int, *by: Column | str) -> DataFrame:
    """The first n rows of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(ordered(keys, *by))).where(F.col("__r") <= n).drop("__r")


def curve_of_growth(df: DataFrame, keys: Sequence[str], radius: str, flux: str, out: str = "growth") -> DataFrame:
    """Adds the share of the key's total flux within the radius; equal radii share a value."""
    upto = ordered(keys, radius).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.try_divide(F.sum(flux).over(upto), F.sum(flux).over(Window.partitionBy(*keys))))


#: Cells of a tile along x and y, and values of their boxes that are sorted together.
_TILE, _SORTED = (256, 512), 4_000_000


def _box_medians(f: pd.DataFrame, half: tuple[int, int]) -> pd.DataFrame:
    """(x, y, median) of a tile's own cells, from all cells (x, y, v) that their boxes reach."""
    tile = [int(f[c].iloc[0]) for c in ("__tx", "__ty")]
    # the place within the tile, whose own cells begin behind the reach of the box
    x, y = (f[c].to_numpy() - t * size + h for c, t, size, h in zip("xy", tile, _TILE, half))
    inside = (x >= half[0]) & (x < half[0] + _TILE[0]) & (y >= half[1]) & (y < half[1] + _TILE[1])
    if not inside.any():  # only cells that the boxes of others reach, of which there are none: less than a box
        return pd.DataFrame({"x": x[:0], "y": y[:0], "m": np.empty(0), "empty": np.zeros(0, bool)})
    shape = [min(size + 2 * h, int(p.max()) + h + 1) for size, h, p in zip(_TILE, half, (x, y))]
    f = f.assign(px=x, py=y)
    some = f[f["v"].notna() | f["nan"]]
    layer = some.groupby(["px", "py"]).cumcount().to_numpy()  # a cell may be there several times
    # what is absent is sorted last, as NaN is
    values, there = np.full((max(1, layer.max(initial=0) + 1), *shape), np.nan), np.zeros(shape, int)
    values[layer, some["px"], some["py"]] = some["v"]
    np.add.at(there, (some["px"], some["py"]), 1)
    box = [2 * h + 1 for h in half]
    views = np.lib.stride_tricks.sliding_window_view(values, box, axis=(1, 2))
    counts = np.lib.stride_tricks.sliding_window_view(there, box)
    own = np.unique(np.stack([x, y], 1)[inside] - half, axis=0)
    out, empty, step = np.empty(len(own)), np.zeros(len(own), bool), max(1, _SORTED // (len(values) * box[0] * box[1]))
    for k in range(0, len(own), step):
        i, j = own[k : k + step].T
        boxes = np.sort(np.moveaxis(views[:, i, j], 0, 1).reshape(len(i), -1), axis=1)
        n, at = counts[i, j].sum((1, 2)), np.arange(len(i))
        out[k : k + step] = 0.5 * boxes[at, np.maximum(n - 1, 0) // 2] + 0.5 * boxes[at, np.minimum(n // 2, boxes.shape[1] - 1)]
        empty[k : k + step] = n == 0
    return pd.DataFrame({"x": own[:, 0] + tile[0] * _TILE[0], "y": own[:, 1] + tile[1] * _TILE[1], "m": out, "empty": empty})


def running_median_2d(df: DataFrame, keys: Sequence[str], x: str, y: str, value: str, half_x: int, half_y: int, out: str = "running") -> DataFrame:
    """Adds the median of the cells in a box about each; absent cells don't count, and a box without values has NULL.

    Cells meet in tiles, each with the cells about it that its boxes reach, so
    that few cells are in more than one tile. x and y are whole numbers.
    """
    half, v = (half_x, half_y), F.col(value).cast("double")
    named = [F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)]
    cells = df.select(*named, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), v.alias("v"), F.coalesce(F.isnan(v), F.lit(False)).alias("nan"))
    for c, h, size in zip("xy", half, _TILE):
        cells = cells.withColumn(f"__t{c}", F.explode(F.sequence(F.floor((F.col(c) - h) / size), F.floor((F.col(c) + h) / size))))
    groups = [*[f"__k{n}" for n in range(len(keys))], "__tx", "__ty"]

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found = _box_medians(f, half)
        for n in range(len(keys)):
            found[f"__k{n}"] = key[n]
        return found

    types = dict(cells.dtypes)
    schema = ", ".join(["x long", "y long", "m double", "empty boolean", *[f"__k{n} {types[f'__k{n}']}" for n in range(len(keys))]])
    found = dealt(cells, *groups).groupBy(*groups).applyInPandas(solve, schema)
    found = found.select(*[F.col(f"__k{n}").alias(k) for n, k in enumerate(keys)], F.col("x").alias(x), F.col("y").alias(y), F.when(~F.col("empty"), F.col("m")).alias(out))
    return df.join(found, [*keys, x, y])
