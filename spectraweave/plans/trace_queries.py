"""Traces over the driver's tables: a made flat frame whose fibers are the spectra of an exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import traces
from .sql_tools import robust_sql, poly_sql
from .registry import SPEC, query, rounded, s6, spectra

CHUNKS = 8
#: A fiber's center row by its number within the exposure and the column: fibers 8 rows apart, tilted and bent.
TRACE = "6 + 8 * rw + 0.01 * (idx - 32) + 0.0002 * pow(idx - 32, 2) * (1 + exp / 10)"
ORDERED = f"(SELECT *, row_number() OVER (PARTITION BY exp, idx ORDER BY fiber) - 1 AS rw FROM {SPEC})"
FLAT = f"""(SELECT exp, rw_ AS row, idx AS col, 0.3 + rw_ / 1000.0 + sum(f * exp(-0.5 * pow((rw_ - t) / 1.6, 2))) AS flux FROM (
    SELECT exp, idx, t, f, CAST(floor(t) AS BIGINT) + o AS rw_ FROM (SELECT exp, idx, {TRACE} AS t, CASE WHEN fiber % 25 = 7 THEN 0 ELSE 20 + abs(flux) END AS f FROM {ORDERED}),
    range(-5, 7) r(o)) WHERE rw_ >= 0 GROUP BY 1, 2, 3)"""
PLACES = "(SELECT exp, row_number() OVER (PARTITION BY exp ORDER BY fiber) - 1 AS fiber, 6.0 + 8 * (row_number() OVER (PARTITION BY exp ORDER BY fiber) - 1) AS position, (fiber % 25 = 7)::INT AS dead FROM (SELECT vec_id AS fiber, label AS exp FROM embeddings))"


def flat_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(exp, row, col, flux): the spectra as light along their traces, on a sloping pedestal; every 25th fiber is dark."""
    rows = spectra(spark, sf_dir).withColumn("rw", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    lit = F.when(F.col("fiber") % 25 == 7, 0.0).otherwise(20 + F.abs("flux"))
    rows = rows.select("exp", F.col("idx").alias("col"), F.expr(TRACE).alias("t"), lit.alias("f")).withColumn("row", F.explode(F.sequence(F.floor("t") - 5, F.floor("t") + 6)))
    light = F.sum(F.col("f") * F.exp(-0.5 * F.pow((F.col("row") - F.col("t")) / 1.6, 2)))
    return rows.where("row >= 0").groupBy("exp", "row", "col").agg(light.alias("l")).select("exp", "row", "col", (0.3 + F.col("row") / 1000 + F.col("l")).alias("flux"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).where("idx = 0").withColumn("rw", F.row_number().over(Window.partitionBy("exp").orderBy("fiber")) - 1)
    return rows.select("exp", F.col("rw").alias("fiber"), (6.0 + 8 * F.col("rw")).alias("position"), (F.col("fiber") % 25 == 7).cast("int").alias("dead"))


PROFILE = f"(SELECT exp, col // {64 // CHUNKS} AS chunk, row, avg(col) AS at_, median(flux) AS flux FROM {FLAT} GROUP BY 1, 2, 3)"
LOW = f"(SELECT *, quantile_cont(flux, 0.05) OVER (PARTITION BY exp, chunk ORDER BY row ROWS BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS low FROM {PROFILE})"


def smoothed_sql(column: str, kernel: list[float]) -> str:
    half = len(kernel) // 2
    at = [f"lag({column}, {half - j}) OVER w" if j < half else f"lead({column}, {j - half}) OVER w" for j in range(len(kernel))]
    total, weight = (" + ".join(f"coalesce({a if v else f'({a}) * 0 + 1'}, 0) * {k!r}" for a, k in zip(at, kernel)) for v in (True, False))
    return f"({total}) / ({weight})"


CLEAN = f"(SELECT *, {smoothed_sql('c', traces.gaussian_kernel(1.5))} AS clean FROM (SELECT *, flux - base AS c FROM {poly_sql(LOW, ['exp', 'chunk'], 'row', 'low', 2, 'base')}) WINDOW w AS (PARTITION BY exp, chunk ORDER BY row))"
RISING = f"""(SELECT p.*, n_good, n_all, row_number() OVER (PARTITION BY p.exp, chunk ORDER BY clean DESC, row) AS r FROM (
    SELECT exp, chunk, at_, row, clean, row - (b - a) / (2 * (b - 2 * flux + a)) AS peak FROM (SELECT *, lag(clean) OVER w AS c0, lead(clean) OVER w AS c1, lag(flux) OVER w AS a, lead(flux) OVER w AS b FROM {CLEAN}
    WINDOW w AS (PARTITION BY exp, chunk ORDER BY row)) WHERE clean > c0 AND clean > c1) p JOIN (SELECT exp, count(*) FILTER (dead = 0) AS n_good, count(*) AS n_all FROM {PLACES} GROUP BY 1) USING (exp))"""
PEAKS = f"""(SELECT exp, chunk, at_, row, peak FROM (SELECT *, count(*) FILTER (r <= n_all AND clean >= mid / 2) OVER v AS high FROM (
    SELECT *, max(CASE WHEN r = ceil(n_good / 2) THEN clean END) OVER v AS mid FROM {RISING} WINDOW v AS (PARTITION BY exp, chunk)) WINDOW v AS (PARTITION BY exp, chunk))
    WHERE r <= CASE WHEN high >= n_all THEN n_all ELSE n_good END)"""
PLACED = f"""(WITH l AS (SELECT *, count(*) OVER v AS n_all, count(*) FILTER (dead = 0) OVER v AS n_good, row_number() OVER (PARTITION BY exp ORDER BY fiber) AS k_all,
        sum((dead = 0)::INT) OVER (PARTITION BY exp ORDER BY fiber) AS k_good FROM {PLACES} WINDOW v AS (PARTITION BY exp)),
    p AS (SELECT *, row_number() OVER (PARTITION BY exp, chunk ORDER BY row) AS k, count(*) OVER (PARTITION BY exp, chunk) AS n FROM {PEAKS}),
    s AS (SELECT exp, chunk, at_, fiber, position, peak, n = n_good AS good FROM p JOIN l USING (exp) WHERE n = n_good AND dead = 0 AND k = k_good OR n = n_all AND n_all > n_good AND k = k_all),
    d AS (SELECT a.exp, a.fiber AS dead, a.position, arg_min(b.fiber, [abs(b.fiber - a.fiber), b.fiber]) AS fiber FROM l a JOIN l b ON a.exp = b.exp AND a.dead = 1 AND b.dead = 0 GROUP BY 1, 2, 3)
    SELECT exp, chunk, at_, fiber, peak AS trace, false AS filled FROM s UNION ALL SELECT s.exp, chunk, at_, d.dead, peak + d.position - s.position, true FROM s JOIN d USING (exp, fiber) WHERE good)"""


@query(f"SELECT exp, chunk, at_ AS \"at\", fiber, {s6('trace')} AS trace, filled FROM {PLACED}")
def fit_trace_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every chunk's profile, dealt to the fibers; dead ones from their neighbours."""
    frame, where = flat_frame(spark, sf_dir), places(spark, sf_dir)
    clean = traces.without_pedestal(traces.chunk_profiles(frame, ["exp"], "flux", CHUNKS), ["exp", "chunk"], "flux")
    peaks = traces.profile_peaks(clean, ["exp", "chunk"], "flux", "clean", traces.expected(where, ["exp"]), ["exp"])
    return rounded(traces.fiber_peaks(peaks, where, ["exp"]))


KNOTS = f"(SELECT exp, fiber, at_, trace FROM {PLACED} UNION ALL SELECT exp, fiber, i, NULL FROM {PLACES}, range(0, 64) r(i))"


@query(f"SELECT exp, fiber, at_::INT AS col, {s6('model')} AS trace FROM {robust_sql(KNOTS, ['exp', 'fiber'], 'at_', 'trace', 4, 5, span=('-0.5', '63.5'))} WHERE trace IS NULL")
def fit_fiber_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of every fiber of every exposure, from a flat frame."""
    return rounded(traces.fiber_traces(flat_frame(spark, sf_dir), places(spark, sf_dir), ["exp"], "flux", CHUNKS))
