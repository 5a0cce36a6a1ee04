"""Quality measures, statuses and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import global_mad_std
from .robust import MAD_TO_SIGMA, median, with_deviation

RANKS = ("pass", "warn", "fail")


def status(value: Column, warn: float, fail: float) -> Column:
    """pass, warn or fail of a value against its limits; a missing value fails."""
    return F.when(value.isNull() | F.isnan(value) | (value >= fail), "fail").when(value >= warn, "warn").otherwise("pass")


def qa_status(metrics: DataFrame, keys: Sequence[str], limits: Mapping[str, tuple[float, float]], no_frames: Column | None = None) -> DataFrame:
    """By row of metrics: a map of checks to (value, status, warn, fail), and the worst as overall; no frames at all fails."""
    checks = {k: F.struct(F.col(k).cast("double").alias("value"), status(F.col(k).cast("double"), w, f).alias("status"), F.lit(float(w)).alias("warn"), F.lit(float(f)).alias("fail")) for k, (w, f) in limits.items()}
    rank = F.array(*[F.array_position(F.array(*map(F.lit, RANKS)), c["status"]) for c in checks.values()])
    worst = F.element_at(F.array(*map(F.lit, RANKS)), F.array_max(rank).cast("int"))
    overall = worst if no_frames is None else F.when(no_frames, "fail").otherwise(worst)
    return metrics.select(*keys, F.create_map(*[x for k, c in checks.items() for x in (F.lit(k), c)]).alias("checks"), overall.alias("overall"))


def qa_report(records: DataFrame, amp: str, checks: Sequence[str]) -> DataFrame:
    """A row an amp and a column a check, with the statuses, by amp."""
    rows = records.select(amp, "overall", F.explode("checks").alias("check", "c"))
    return rows.groupBy(amp, "overall").pivot("check", list(checks)).agg(F.first("c.status")).orderBy(amp)


def to_json(records: DataFrame) -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns)).alias("json"))


def from_json(lines: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Records of JSON lines; malformed ones are dropped."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("r"), F.col(column).alias("__j")).where("r is not null and try_parse_json(__j) is not null").select("r.*")


def amp_metrics(fibers: DataFrame, amp: str, values: Sequence[str], masked: Column, warn: float = 0.2, fail: float = 0.5) -> DataFrame:
    """By amp: medians and MADs of the values, share masked, and counts of fibers beyond warn and fail of the first value."""
    aggs = [F.avg(masked.cast("double")).alias("masked_share"), F.count(F.when(F.col(values[0]) > warn, 1)).alias("n_warn"), F.count(F.when(F.col(values[0]) > fail, 1)).alias("n_fail")]
    rows = fibers
    for v in values:
        rows = with_deviation(rows, [amp], v).withColumnRenamed("__mad", f"__mad_{v}").drop("__m", "__d")
        aggs += [median(F.col(v)).alias(f"{v}_median"), (F.first(f"__mad_{v}", True) * MAD_TO_SIGMA).alias(f"{v}_mad")]
    return rows.groupBy(amp).agg(*aggs)


def band_residuals(df: DataFrame, keys: Sequence[str], i: str, residual: str, bands: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Median, deviation and MAD of the residual in bands [low, high) of bins."""
    band = F.coalesce(*[F.when(F.col(i).between(a, b - 1), F.lit(k)) for k, (a, b) in bands.items()])
    rows = with_deviation(df.withColumn("band", band).where("band is not null"), [*keys, "band"], residual)
    return rows.groupBy(*keys, "band").agg(median(F.col(residual)).alias("median"), F.stddev_pop(residual).alias("std"), (F.first("__mad", True) * MAD_TO_SIGMA).alias("mad"))


def histogram(df: DataFrame, x: Column, low: float, high: float, bins: int) -> DataFrame:
    """Density of x in equal bins over [low, high); what lies outside doesn't count."""
    binned = df.select(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).where(F.col("bin").between(1, bins))
    counts = binned.groupBy("bin").count()
    whole = counts.agg(F.sum("count").alias("__n"))
    width = (high - low) / bins
    return counts.crossJoin(F.broadcast(whole)).select("bin", F.col("count").alias("n"), (F.col("count") / F.col("__n") / width).alias("density"))


def error_rescale(df: DataFrame, flux: str, error: str) -> DataFrame:
    """Adds the error scaled by one factor so that flux / error has a MAD deviation of 1."""
    factor = global_mad_std(df, F.try_divide(F.col(flux), F.col(error)), "__factor")
    return df.crossJoin(F.broadcast(factor)).withColumn("rescaled", F.col(error) * F.col("__factor")).drop("__factor")


def binned_scatter(df: DataFrame, x: str, diff: str, low: float, high: float, bins: int) -> DataFrame:
    """Median and MAD of a difference in equal bins of a reference."""
    rows = df.withColumn("bin", F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins))).where(F.col("bin").between(1, bins))
    return with_deviation(rows, ["bin"], diff).groupBy("bin").agg(median(F.col(diff)).alias("median"), (F.first("__mad", True) * MAD_TO_SIGMA).alias("mad"), F.count("*").alias("n"))


def dark_structure(dark: DataFrame, keys: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """Median of absolute differences of neighbouring pixels along rows."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys, row).orderBy(col)))
    return dark.withColumn("__s", step).groupBy(*keys).agg(median(F.col("__s")).alias("structure"))
