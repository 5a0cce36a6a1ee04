"""Joins that Spark has no operator for: sky ranges, nearest, as-of, intervals.

Range joins put both sides in cells of the range's size and meet on equal cells;
one side is also put in the neighbouring cells. So the work follows the number of
close pairs, and no side need fit in memory.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sky import offsets, separation, zone_keys
from .lineage import cut


def _suffixed(df: DataFrame, mark: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{mark}") for c in df.columns])


def within_radius(
    left: DataFrame, right: DataFrame, radius: float, pos: tuple[str, str] = ("ra", "dec"), flat: bool = False, marks: tuple[str, str] = ("_l", "_r"), keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs of rows within `radius` arcseconds and of equal keys, columns marked by side, with sep, dra and ddec of right from left."""
    ra, dec = pos
    a = _suffixed(left.withColumn("__cell", F.explode(zone_keys(F.col(ra), F.col(dec), radius, False))), marks[0])
    b = _suffixed(right.withColumn("__cell", F.explode(zone_keys(F.col(ra), F.col(dec), radius, True))), marks[1])
    same = F.col(f"__cell{marks[0]}") == F.col(f"__cell{marks[1]}")
    for k in keys:
        same = same & (F.col(f"{k}{marks[0]}") == F.col(f"{k}{marks[1]}"))
    met = a.join(b, same)
    p = [F.col(f"{c}{m}") for m in marks for c in pos]
    dra, ddec = offsets(*p)
    sep = F.sqrt(dra * dra + ddec * ddec) if flat else separation(*p)
    return met.drop(f"__cell{marks[0]}", f"__cell{marks[1]}").withColumns({"dra": dra, "ddec": ddec, "sep": sep}).where(F.col("sep") <= radius)


def cone_search(catalog: DataFrame, centers: DataFrame, radius: float, pos: tuple[str, str] = ("ra", "dec"), keep: Column | None = None) -> DataFrame:
    """Catalog rows (columns marked _r) around each center (_l); `keep` is a further condition on the catalog."""
    return within_radius(centers, catalog if keep is None else catalog.where(keep), radius, pos)


#: Distinct positions that a cell of the first radius may hold, and how often the radius is halved at most for it.
_CROWD, _HALVINGS = 8, 24


def _first_radius(places: DataFrame, most: float, pos: tuple[str, str]) -> float:
    """The radius, `most` halved so often that its cells hold few of the distinct places."""
    radius = most
    for _ in range(_HALVINGS):
        cell = zone_keys(F.col(pos[0]), F.col(pos[1]), radius, False)[0]
        top = places.groupBy(cell.alias("__cell")).count().agg(F.max("count")).first()[0] or 0
        if top <= _CROWD:
            break
        radius /= 2 ** max(1, math.floor(math.log(top / _CROWD, 4)))
    return radius


def nearest_match(a: DataFrame, b: DataFrame, a_id: str, b_id: str, max_sep: float, pos: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """For each row of a its nearest of b within max_sep arcseconds: ids, sep, dra, ddec; ties to the smaller id; none: NULL.

    Equal positions are looked up once. The radius starts where few of b are in
    reach and doubles up to max_sep for the positions that found none: what is
    nearest within a radius is nearest of all, so pairs don't grow with the square
    of a dense field's rows.
    """
    places = cut(b.where(F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull()).groupBy(*pos).agg(F.min(b_id).alias("__match")))
    todo = cut(a.select(*pos).where(F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull()).distinct())
    radius, found = _first_radius(places, max_sep, pos), None
    while True:
        near = within_radius(places, todo, radius, pos, marks=("_b", "_a"))
        at = [F.col(f"{c}{m}") for m in ("_a", "_b") for c in pos]
        dra, ddec = offsets(*at)
        pick = F.struct("sep", F.col("__match_b").alias("match"), dra.alias("dra"), ddec.alias("ddec"))
        best = near.groupBy(*[F.col(f"{c}_a").alias(c) for c in pos]).agg(F.min(pick).alias("__best"))
        best = cut(todo.join(best, list(pos), "left"))
        hit = best.where("__best is not null")
        found = hit if found is None else found.unionByName(hit)
        todo = best.where("__best is null").drop("__best")
        if radius >= max_sep or todo.isEmpty():
            return a.select(a_id, *pos).join(found, list(pos), "left").select(a_id, "__best.match", "__best.sep", "__best.dra", "__best.ddec")
        radius = min(2 * radius, max_sep)


def flag_near(df: DataFrame, marks: DataFrame, radius: float, id_col: str, pos: tuple[str, str] = ("ra", "dec"), out: str = "near") -> DataFrame:
    """Adds whether a row lies within `radius` arcseconds of any mark, by its nearest."""
    hit = nearest_match(df, marks.withColumn("__mark", F.lit(1)), id_col, "__mark", radius, pos).groupBy(id_col).agg(F.max(F.col("match").isNotNull()).alias(out))
    return df.join(hit, id_col, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def repeat_pairs(df: DataFrame, radius: float, shot: str, pos: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Pairs of rows at one place in different shots, each pair once (smaller shot left)."""
    return within_radius(df, df, radius, pos).where(F.col(f"{shot}_l") < F.col(f"{shot}_r"))


def slot_neighbors(slots: DataFrame, distance: int, x: str = "x", y: str = "y", id_col: str = "slot") -> DataFrame:
    """Pairs of slots in a square neighbourhood, without the slot itself.

    Meets on cells of the distance's size, so that it holds for any grid.
    """
    size = distance + 1
    here = slots.select(F.col(id_col).alias("slot"), F.col(x).alias("x"), F.col(y).alias("y"))
    cells = here.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = cells.withColumn("s", F.explode(steps)).select(
        F.col("slot").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")
    )
    close = (F.abs(F.col("x") - F.col("nx")) <= distance) & (F.abs(F.col("y") - F.col("ny")) <= distance) & (F.col("slot") != F.col("neighbor"))
    return cells.join(near, ["cx", "cy"]).where(close).select("slot", "neighbor")


def box_cutout(
    fibers: DataFrame, half: float, buffer: float, step: float, x: str = "x", y: str = "y", out: str = "tile", spectrum: str | None = None, least: int = 50
) -> DataFrame:
    """A row for each overlapping tile (number of column, of row) that a fiber lies in.

    Tiles have their centers every `step` and reach half + buffer from them. With
    spectrum, an array, only fibers of more than `least` valid bins count.
    """
    reach = half + buffer
    if spectrum is not None:
        fibers = fibers.where(F.size(F.filter(spectrum, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))) > least)

    def covering(c: str) -> Column:
        low, high = F.ceil((F.col(c) - reach) / step), F.floor((F.col(c) + reach) / step)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    return fibers.withColumn(f"{out}_x", F.explode(covering(x))).withColumn(f"{out}_y", F.explode(covering(y)))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    right_id: str,
    left_id: str,
    mode: str = "backward",
    tolerance: float | None = None,
    out: str = "match",
    bucket: float | None = None,
) -> DataFrame:
    """Adds to left the id of the right row before it in time (backward) or nearest to it (nearest).

    tolerance is in seconds. Of right rows at one time the smallest id counts;
    a nearest tie goes to the earlier row. One shuffle by the keys; where a key may
    hold very many rows, give a bucket in seconds: rows are then dealt by key and
    bucket, and the last and first right rows of the others are carried over.
    """
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    a = left.withColumn("__t", seconds).withColumn("__r", F.lit(None).cast("struct<t:double,id:bigint>")).withColumn("__side", F.lit(1))
    b = right.groupBy(*keys, seconds.alias("__t")).agg(F.min(F.col(right_id).cast("bigint")).alias("id"))
    b = b.withColumn("__r", F.struct(F.col("__t").alias("t"), "id")).drop("id").withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    group = [*keys] if bucket is None else [*keys, "__bucket"]
    if bucket is not None:
        both = both.withColumn("__bucket", F.floor(F.col("__t") / bucket))
        row = F.when(F.col("__side") == 0, F.col("__r"))
        ends = both.groupBy(*group).agg(F.max(row).alias("__last"), F.min(row).alias("__first"))
        along = Window.partitionBy(*keys).orderBy("__bucket")
        ends = ends.withColumn("__before", F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        ends = ends.withColumn("__after", F.first("__first", True).over(along.rowsBetween(1, Window.unboundedFollowing))).drop("__last", "__first")
        both = both.join(ends, group, "left")
    line = Window.partitionBy(*group).orderBy("__t", "__side")
    before, after = F.last("__r", True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first("__r", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = both.withColumn("__b", before if bucket is None else F.coalesce(before, F.col("__before")))
    if mode == "nearest":
        rows = rows.withColumn("__f", after if bucket is None else F.coalesce(after, F.col("__after")))
        later = F.col("__f.t") - F.col("__t") < F.col("__t") - F.col("__b.t")
        rows = rows.withColumn("__b", F.when(F.col("__b").isNull() | later, F.col("__f")).otherwise(F.col("__b")))
    gap = F.abs(F.col("__t") - F.col("__b.t"))
    match = F.col("__b.id") if tolerance is None else F.when(gap <= tolerance, F.col("__b.id"))
    return rows.where("__side = 1").withColumn(out, match).select(*left.columns, out)


def during(points: DataFrame, spans: DataFrame, ts: str, start: str, end: str, pad: float = 10.0, bucket: float = 3600.0) -> DataFrame:
    """Pairs of points (columns _l) and spans (_r) with start - pad <= ts <= end + pad, met on time buckets."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    a = points.withColumn("__k", F.floor(sec(ts) / bucket))
    b = spans.withColumn("__k", F.explode(F.sequence(F.floor((sec(start) - pad) / bucket), F.floor((sec(end) + pad) / bucket))))
    a, b = _suffixed(a, "_l"), _suffixed(b, "_r")
    inside = (sec(f"{ts}_l") >= sec(f"{start}_r") - pad) & (sec(f"{ts}_l") <= sec(f"{end}_r") + pad)
    return a.join(b, F.col("__k_l") == F.col("__k_r")).where(inside).drop("__k_l", "__k_r")


def match_lines(peaks: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, line: str, tolerance: float) -> DataFrame:
    """The nearest peak to each line within the tolerance, a peak used once, by the first line in order that is nearest to it.

    Both meet on cells of the tolerance's size.
    """
    size = tolerance if tolerance > 0 else 1.0
    a = lines.select(F.col(line).alias("line")).withColumn("__c", F.floor(F.col("line") / size))
    b = peaks.select(*keys, F.col(x).alias("peak")).withColumn("__c", F.explode(F.array(*[F.floor(F.col("peak") / size) + s for s in (-1, 0, 1)])))
    met = a.join(b, "__c").withColumn("gap", F.abs(F.col("line") - F.col("peak"))).where(F.col("gap") <= tolerance)
    best = met.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "line").orderBy("gap", "peak"))).where("__r = 1")
    once = best.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "peak").orderBy("line"))).where("__r = 1")
    return once.select(*keys, "line", "peak", "gap")


def interval_mask(df: DataFrame, intervals: DataFrame, keys: Sequence[str], date: str, value: str, start: str = "date_from", end: str = "date_to") -> DataFrame:
    """df with `value` NULL where a row's keys are listed for an interval [start, end) that holds its date."""
    spans = intervals.groupBy(*keys).agg(F.collect_list(F.struct(F.col(start).alias("a"), F.col(end).alias("b"))).alias("__spans"))
    rows = df.join(spans, list(keys), "left")
    hit = F.coalesce(F.exists("__spans", lambda s: (F.col(date) >= s["a"]) & (F.col(date) < s["b"])), F.lit(False))
    return rows.withColumn(value, F.when(~hit, F.col(value))).select(*df.columns)


def project_mask(mask: DataFrame, trace: DataFrame, keys: Sequence[str], fiber: str, col: str, half: int, n_rows: int) -> DataFrame:
    """Detector pixels (row, col) within `half` rows of a masked bin's trace, each once."""
    met = mask.select(*keys, fiber, col).join(trace.select(*keys, fiber, col, "trace"), [*keys, fiber, col])
    at = F.round("trace").cast("int")
    near = met.withColumn("row", F.explode(F.sequence(at - half, at + half)))
    return near.where((F.col("row") >= 0) & (F.col("row") < n_rows)).select(*keys, "row", col).distinct()
