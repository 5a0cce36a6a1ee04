"""Detections in cubes: voxels above a threshold, grouped where they are linked, each group extracted again and fitted."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import continuum
from .extraction import line_fit_grid, sn_cube
from .lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(u, v): root is the smallest node that can be reached; nodes are of any type with an order.

    Each node's neighbours are tied to the smallest of them, by turns those above it
    and those below, until nothing changes: grouped minima and joins, so that no
    list of neighbours is ever gathered.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while (state := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen and state[0]:
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def linked_groups(points: DataFrame, keys: Sequence[str], at: Sequence[str], scale: Sequence[float], link: float, out: str = "group") -> DataFrame:
    """Adds the group of each point by keys: points within `link` of each other, in scaled axes, are in one group, and so on from point to point.

    Points are put in cells so small that all of a cell are linked. So cells are
    grouped, not points, and only points of cells a few steps apart are compared;
    `out` is the first cell of the group.
    """
    side = link / math.sqrt(len(at))
    reach = math.ceil(link / side)
    place = [F.floor(F.col(a) * s / side) for a, s in zip(at, scale)]
    rows = points.withColumn("__cell", F.struct(*[c.alias(f"c{n}") for n, c in enumerate(place)]))
    ahead = [d for d in itertools.product(range(-reach, reach + 1), repeat=len(at)) if d > (0,) * len(at)]
    steps = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"d{n}") for n, x in enumerate(d)]) for d in ahead])
    far = rows.select(*keys, *[F.col(a).alias(f"__b{n}") for n, a in enumerate(at)], F.col("__cell").alias("__other"), F.explode(steps).alias("d"))
    far = far.withColumn("__cell", F.struct(*[(F.col(f"__other.c{n}") + F.col(f"d.d{n}")).alias(f"c{n}") for n in range(len(at))]))
    gap = sum((F.pow((F.col(a) - F.col(f"__b{n}")) * s, 2) for n, (a, s) in enumerate(zip(at, scale))), F.lit(0.0))
    near = rows.join(far, [*keys, "__cell"]).where(gap <= link * link)
    node = lambda cell: F.struct(*keys, F.col(cell).alias("cell"))
    roots = components(near.select(node("__cell").alias("u"), node("__other").alias("v")).distinct())
    met = rows.withColumn("__node", node("__cell")).join(roots.withColumnRenamed("node", "__node"), "__node", "left")
    return met.withColumn(out, F.coalesce("root.cell", "__cell")).select(*points.columns, out)


def detect_lines(
    voxels: DataFrame, axes: tuple[str, str, str], flux: str, error: str, bins: int, kernel: Sequence[float], threshold: float = 5.0, reach: float = 2.0, steps: int = 9,
    widths: Sequence[float] = (1.0, 1.5, 2.0, 2.5, 3.0), half: float = 6.0, keys: Sequence[str] = (), link: float = 2.5, scale: Sequence[float] = (1.0, 1.0, 1.0),
    sigma: float = 1.0, radius: float = 2.5, most: int | None = None,
) -> DataFrame:
    """(keys, x, y, i, sn, n_voxels, xc, yc, centre, width, amplitude, chi2, flux): emission lines, one row for each group of linked voxels above the threshold.

    x, y, i and sn are those of the group's highest voxel. The place (xc, yc) is the
    centroid of the S/N about the group's own, at its wavelength; there the spectrum
    is extracted again, with weights of a Gaussian of `sigma` cells that is 1 at the
    center, and a Gaussian is fitted to it. A field (keys) of more than `most` voxels
    above the threshold has no detections; a line with a missing bin has none.
    """
    x, y, i = axes
    at, spot = [*keys, x, y], [*keys, "__spot"]
    cube = cut(sn_cube(voxels, at, i, flux, error, bins, kernel, field=keys).select(*at, i, flux, error, "sn"))
    bright = cube.where(F.col("sn") > threshold).select(*at, i, "sn")
    if most is not None:
        counts = bright.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else bright.agg(F.count("*").alias("__n"))
        bright = (bright.join(counts, list(keys)) if keys else bright.crossJoin(F.broadcast(counts))).where(F.col("__n") <= most).drop("__n")
    groups = linked_groups(cut(bright), keys, axes, scale, link, "__spot")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("sn")), F.sum("sn"))
    top = F.max(F.struct("sn", (-F.col(x)).alias("x"), (-F.col(y)).alias("y"), (-F.col(i)).alias("i"))).alias("__t")
    found = groups.groupBy(*spot).agg(top, F.count("*").alias("n_voxels"), mean(x).alias("__x"), mean(y).alias("__y"), F.round(mean(i)).alias("__i"))
    found = cut(found.select(*spot, (-F.col("__t.x")).alias("__tx"), (-F.col("__t.y")).alias("__ty"), (-F.col("__t.i")).alias("__peak"), "__t.sn", "n_voxels", "__x", "__y", F.col("__i").cast("long").alias("__i")))
    # a detection goes to the cells near it
    n = math.ceil(radius)
    steps_ = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-n, n + 1) for b in range(-n, n + 1)])

    def around(df: DataFrame, px: str, py: str) -> DataFrame:
        cells = df.withColumn("s", F.explode(steps_)).withColumn(x, F.round(px).cast("long") + F.col("s.a")).withColumn(y, F.round(py).cast("long") + F.col("s.b")).drop("s")
        return cells.withColumn("__r2", F.pow(F.col(x) - F.col(px), 2) + F.pow(F.col(y) - F.col(py), 2)).where(F.col("__r2") <= radius * radius)

    slice_ = around(found.select(*spot, "__x", "__y", "__i"), "__x", "__y").join(cube.select(*at, F.col(i).cast("long").alias("__i"), F.greatest("sn", F.lit(0.0)).alias("sn")), [*at, "__i"])
    places = slice_.groupBy(*spot).agg(mean(x).alias("xc"), mean(y).alias("yc"))
    placed = found.join(places, spot, "left").withColumn("xc", F.coalesce("xc", "__x")).withColumn("yc", F.coalesce("yc", "__y"))
    level = continuum(cube, at, i, flux, bins, "__level").withColumn("__line", F.col(flux) - F.col("__level"))
    w = F.exp(-0.5 * F.col("__r2") / sigma**2)
    iv = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    samples = around(placed.select(*spot, "__peak", "xc", "yc"), "xc", "yc").join(level.select(*at, i, "__line", error), at).where(F.abs(F.col(i) - F.col("__peak")) <= half)
    ok = F.col("__line").isNotNull()
    again = samples.groupBy(*spot, "__peak", i).agg(
        F.try_divide(F.sum(F.col("__line") * w * iv), F.sum(F.when(ok, w * w * iv))).alias("__f"), F.sqrt(F.try_divide(F.sum(F.when(ok, w)), F.sum(F.when(ok, w * w * iv)))).alias("__e")
    )
    fits = line_fit_grid(again, spot, i, "__f", "__e", "__peak", reach, steps, widths, half)
    out = placed.join(fits, spot)
    return out.select(*keys, F.col("__tx").alias(x), F.col("__ty").alias(y), F.col("__peak").alias(i), "sn", "n_voxels", "xc", "yc", "centre", "width", "amplitude", "chi2", "flux")
