"""Sinks: partitioned tables, cubes, exports, and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_date(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> None:
    """A table in folders by date, each date's rows dealt together, so that it gets few files; very large dates are split."""
    df.hint("rebalance", date).write.mode(mode).partitionBy(date).parquet(path)


def write_cube(voxels: DataFrame, grid: DataFrame, path: str) -> None:
    """Voxels and, beside them, the one-row grid description."""
    voxels.write.mode("overwrite").parquet(f"{path}/voxels")
    grid.write.mode("overwrite").parquet(f"{path}/grid")


def open_tasks(tasks: DataFrame, outputs: DataFrame, key: str, size: str | None = None, least_bytes: int = 100_000_000) -> DataFrame:
    """Tasks without an output, or whose output is smaller than it must be."""
    done = outputs if size is None else outputs.where(F.col(size) >= least_bytes)
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def fiber_names(df: DataFrame, shot: str, amp: str, ordinal: str, out: str = "fiber_name") -> DataFrame:
    """Adds generated names: shot, amp and the fiber's number within its amp."""
    return df.withColumn(out, F.format_string("%s_%s_%03d", F.col(shot).cast("string"), F.col(amp).cast("string"), F.pmod(F.col(ordinal), F.lit(112)).cast("int") + 1))


def write_attribute(df: DataFrame, path: str, order: str, exp: str = "exp") -> None:
    """One attribute, ordered within each exposure's folder; a large exposure's files hold one stretch of the order each."""
    df.repartitionByRange(exp, order).sortWithinPartitions(exp, order).write.mode("overwrite").partitionBy(exp).parquet(path)
