"""Places in one order of a whole table, and statistics that need them, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut, few
from .robust import MAD_TO_SIGMA

#: Bins that a range of values is cut in, and values of a bin that are sorted at once.
_BINS, _SORTED = 1000, 10_000

#: monotonically_increasing_id counts a partition's rows in its lower bits.
_ROWS = (1 << 33) - 1


def numbered(df: DataFrame, *order: str, out: str = "number", total: str | None = None) -> DataFrame:
    """Adds each row's number, from 0, in the given order, and the count of rows if `total` names a column for it.

    Rows are dealt by range and sorted; with their places they are written before
    partitions are counted, so that a lost executor can't deal them anew in between.
    Only the counts of partitions meet in one task.
    """
    rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__p", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumn("__total", F.sum("__size").over(Window.partitionBy()))
    met = rows.join(F.broadcast(sizes.drop("__size")), "__p").withColumn(out, F.col("__n") + F.col("__before"))
    return met.select(*df.columns, out, *([F.col("__total").alias(total)] if total else []))


def global_median(df: DataFrame, x: Column, out: str = "median") -> DataFrame:
    """One row with the exact median of all values that aren't NULL; NULL without any."""
    rows = numbered(df.select(x.cast("double").alias("__x")).where("__x is not null"), "__x", out="__k", total="__all")
    return rows.where((F.col("__k") == F.floor((F.col("__all") - 1) / 2)) | (F.col("__k") == F.floor(F.col("__all") / 2))).agg(F.avg("__x").alias(out))


def global_biweight(df: DataFrame, x: Column, c: float = 9.0, loc: str = "location", scale: str = "scale") -> DataFrame:
    """One row with the biweight location and scale of all values that aren't NULL."""
    rows = df.select(x.cast("double").alias("__x")).where("__x is not null")
    rows = rows.crossJoin(F.broadcast(global_median(rows, F.col("__x"), "__m"))).withColumn("__d", F.col("__x") - F.col("__m"))
    mad = global_median(rows, F.abs("__d"), "__mad")
    rows = rows.crossJoin(F.broadcast(mad)).withColumn("__u", F.pow(F.try_divide(F.col("__d"), c * F.col("__mad")), 2))
    d, near = F.col("__d"), F.when(F.col("__u") < 1, 1 - F.col("__u"))
    shift = F.try_divide(F.sum(d * near * near), F.sum(near * near))
    spread = F.try_divide(F.sqrt(F.count(near) * F.sum(d * d * F.pow(near, 4))), F.abs(F.sum(near * (1 - 5 * F.col("__u")))))
    return rows.agg((F.first("__m") + F.coalesce(shift, F.lit(0.0))).alias(loc), spread.alias(scale))


def global_mad_std(df: DataFrame, x: Column, out: str = "mad_std") -> DataFrame:
    """One row with 1.4826 times the median distance of all values from their median."""
    rows = df.select(x.cast("double").alias("__x")).crossJoin(F.broadcast(global_median(df, x, "__m")))
    return global_median(rows, F.abs(F.col("__x") - F.col("__m")), "__mad").select((F.col("__mad") * MAD_TO_SIGMA).alias(out))


def _at_ranks(rows: DataFrame, groups: Sequence[str], state: DataFrame) -> DataFrame:
    """(groups, rank, value, next): the rank-th (from 0) and the following __x of each group in order; next is NULL after the last.

    state: groups, rank, the ends __lo and __hi of the group's values, their number
    __in, and how many come __before.
    """
    state, x = cut(state), F.col("__x")
    lo, hi, at = F.col("__lo"), F.col("__hi"), [*groups, "rank"]
    wide = (lo < hi) & (F.col("__in") > _SORTED)
    # infinite ends are taken off first
    share = F.when(x <= lo, 0).when(x >= hi, _BINS).when(hi - lo < float("inf"), F.floor((x - lo) / (hi - lo) * _BINS)).otherwise(1)
    while not (todo := state.where(wide)).isEmpty():
        near = rows.join(few(todo.drop("__in")), list(groups)).where((x >= lo) & (x <= hi))
        bins = near.groupBy(*at, "__before", share.cast("int").alias("__bin")).agg(F.count("*").alias("__in"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        upto = F.sum("__in").over(Window.partitionBy(*at).orderBy("__bin"))
        bins = bins.withColumn("__upto", F.col("__before") + upto).withColumn("__before", F.col("__upto") - F.col("__in"))
        found = bins.where((F.col("__before") <= F.col("rank")) & (F.col("rank") < F.col("__upto")))
        state = cut(found.select(state.columns).unionByName(state.where(~wide)))
    # few values are left between the ends; of those above only the least counts
    left = rows.join(few(state.drop("__in")), list(groups)).where(x >= lo)
    left = left.groupBy(*at, "__before", F.when(x <= hi, x).alias("__v")).agg(F.count("*").alias("__n"), F.min("__x").alias("__y"))
    to = F.col("__before") + F.sum("__n").over(Window.partitionBy(*at).orderBy(F.col("__v").asc_nulls_last()))
    left = left.withColumn("__to", to)
    pick = lambda r: F.max(F.when((F.col("__to") - F.col("__n") <= r) & (r < F.col("__to")), F.col("__y")))
    return left.groupBy(*at).agg(pick(F.col("rank")).alias("value"), pick(F.col("rank") + 1).alias("next"))


def quantiles(rows: DataFrame, groups: Sequence[str], x: Column, p: Sequence[float]) -> DataFrame:
    """(groups, q): the exact percentiles of x by groups as an array, between neighbours by their share.

    No group is sorted or held: values are counted in bins, the bin that holds the
    rank is cut in bins again, and only what is left of a few values is sorted. The
    rows are read anew each time, so they had better be cheap to read. NULL doesn't count.
    """
    rows = rows.select(*groups, x.cast("double").alias("__x")).where("__x is not null")
    ends = rows.groupBy(*groups).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("__in"))
    place = F.col("__p") * (F.col("__in") - 1)
    wanted = cut(ends.withColumn("__p", F.explode(F.array(*map(F.lit, p)))).withColumn("__place", place).withColumn("rank", F.floor(place)))
    found = _at_ranks(rows, groups, wanted.drop("__p", "__place").distinct().withColumn("__before", F.lit(0).cast("long")))
    part = F.col("__place") - F.col("rank")
    q = F.when(part > 0, (1 - part) * F.col("value") + part * F.col("next")).otherwise(F.col("value"))
    met = wanted.join(found.hint("shuffle_hash"), [*groups, "rank"]).withColumn("__q", q)
    return met.groupBy(*groups).agg(F.array(*[F.max(F.when(F.col("__p") == v, F.col("__q"))) for v in p]).alias("q"))
