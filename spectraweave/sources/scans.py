"""Scans of observation tables, logs, keyed text and JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import numbered
from ..operators.traces import even_chunk


def scan_fibers(spark: SparkSession, path: str, columns: Sequence[str], dates: tuple[str, str] | None = None, date: str = "date") -> DataFrame:
    """Named columns of fiber tables; dates [start, end) prune partitions or row groups."""
    df = spark.read.parquet(path)
    if dates:
        df = df.where((F.col(date) >= F.lit(dates[0]).cast("date")) & (F.col(date) < F.lit(dates[1]).cast("date")))
    return df.select(*columns)


def date_range(start: str | None = None, end: str | None = None, days: int | None = None) -> tuple[Column, Column]:
    """First date and end (not included) from two of start, end and length; a length before an end counts the end too."""
    if start and end:
        return F.lit(start).cast("date"), F.lit(end).cast("date")
    if start and days:
        return F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days)
    if end and days:
        return F.date_add(F.lit(end).cast("date"), 1 - days), F.date_add(F.lit(end).cast("date"), 1)
    raise ValueError("give two of start, end and days")


def scan_obs_log(log: DataFrame, ts: str, span: tuple[Column, Column], kind: Column | None = None, pad_days: int = 0) -> DataFrame:
    """Frames within a date range, padded on both sides, of a kind. The bounds stay on the stored column, so that they reach the scan."""
    low, high = F.date_sub(span[0], pad_days), F.date_add(span[1], pad_days)
    kept = log.where((F.col(ts) >= low.cast("timestamp_ntz")) & (F.col(ts) < high.cast("timestamp_ntz")))
    return kept if kind is None else kept.where(kind)


def program_batches(log: DataFrame, program: Column, n: int, *order: str) -> DataFrame:
    """A program's observations in n near-equal batches, in order; earlier batches take the extra ones."""
    rows = numbered(log.where(program), *order, out="__k", total="__all")
    return rows.withColumn("batch", even_chunk(F.col("__k"), F.col("__all"), n) + 1).drop("__k", "__all")


def scan_keyed_text(spark: SparkSession, path: str, pattern: str, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """White-space tables whose keys are groups of a pattern on the file's path; # starts a comment."""
    lines = spark.read.text(path).withColumn("__path", F.input_file_name()).where("trim(value) <> '' and not trim(value) like '#%'")
    parts = F.split(F.trim("value"), r"\s+")
    found = [F.regexp_extract("__path", pattern, i + 1).alias(k) for i, k in enumerate(keys)]
    return lines.select(*found, *[F.get(parts, F.lit(i)).cast(t).alias(c) for i, (c, t) in enumerate(columns.items())])


def first_header_per_obs(log: DataFrame, keys: Sequence[str], defaults: Mapping[str, object], *order: str) -> DataFrame:
    """One row an observation, the first in order; missing fields take their default."""
    first = log.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1")
    return first.select(*keys, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def scan_catalog(catalog: DataFrame, sentinel: float = -999.0) -> DataFrame:
    """Numeric sentinels and NaN become NULL."""
    number = {"double", "float"}
    clean = {c: F.when(~F.isnan(c) & (F.col(c) > sentinel), F.col(c)) if t in number else F.when(F.col(c) > sentinel, F.col(c)) for c, t in catalog.dtypes if t in number | {"int", "bigint", "smallint"}}
    return catalog.withColumns(clean) if clean else catalog


def scan_qa(spark: SparkSession, path: str, schema: str, defaults: Mapping[str, object]) -> DataFrame:
    """JSON records, malformed ones dropped, with defaults."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items()})


def month_calibration(obs: DataFrame, calibration: DataFrame, date: str, month: str) -> DataFrame:
    """Each observation with its month's calibration, and the first day of the next month."""
    rows = obs.withColumn("__month", F.trunc(date, "MM")).withColumn("next_month", F.add_months(F.trunc(date, "MM"), 1))
    return rows.join(calibration, F.col("__month") == F.col(month), "left").drop("__month")


def scan_shot_log(spark: SparkSession, path: str, fields: Mapping[int, tuple[str, str]]) -> DataFrame:
    """Space-separated log lines: (name, type) of fields by place; other fields aren't kept."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.get(parts, F.lit(i)).try_cast(t).alias(c) for i, (c, t) in fields.items()])


def frame_sanity(frames: DataFrame, limits: DataFrame, kind: str, level: str) -> DataFrame:
    """Adds the reason a frame is rejected for: no limits known, no level, too low, too high; NULL for a sound one."""
    rows = frames.join(limits.select(kind, "low", "high"), kind, "left")
    reason = F.when(F.col("low").isNull(), "unknown kind").when(F.col(level).isNull(), "no level").when(F.col(level) < F.col("low"), "too low").when(F.col(level) > F.col("high"), "too high")
    return rows.withColumn("reason", reason).drop("low", "high")
