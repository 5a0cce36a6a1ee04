"""Scattered light, levels, profiles, surfaces and gaps over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grid as grid_ops
from ..operators import models, robust, traces
from .registry import SPEC, biweight_sql, mad_sql, query, rounded, s6, spectra
from .sql_tools import poly_sql
from .trace_queries import FLAT, ORDERED, TRACE, flat_frame


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures as frames: the spectra of each, in order of fiber, are its rows."""
    rows = spectra(spark, sf_dir).withColumn("row", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    return rows.select("exp", "row", F.col("idx").alias("col"), "fiber", "flux")


GRID = f"(SELECT exp, rw AS row, idx AS col, fiber, flux FROM {ORDERED})"


def clipped_sql(src: str, n_sigma: float) -> str:
    """(fiber, idx, c) of src, c NULL where a round clipped it: each fiber's list in as many rounds as it needs, until one takes nothing more out."""
    return f"""(WITH RECURSIVE r AS (SELECT fiber, list(idx ORDER BY idx) AS place, list(c ORDER BY idx) AS v, true AS more FROM {src} GROUP BY 1
    UNION ALL SELECT fiber, place, w, list_aggregate(w, 'count') < list_aggregate(v, 'count') FROM (SELECT fiber, place, v, list_transform(v, lambda x: CASE WHEN abs(x - m) <= {n_sigma} * s THEN x END) AS w
    FROM (SELECT *, 1.4826 * list_aggregate(list_transform(v, lambda x: abs(x - m)), 'median') AS s FROM (SELECT *, list_aggregate(v, 'median') AS m FROM r WHERE more))))
    SELECT fiber, unnest(place) AS idx, unnest(v) AS c FROM r WHERE NOT more)"""


CLIPPED = clipped_sql(f"(SELECT fiber, idx, flux AS c FROM {SPEC})", 2.0)


@query(f"SELECT fiber, idx, {s6('c')} AS clipped FROM {CLIPPED}")
def rob_sigma_clip_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sigma clips of every spectrum until nothing more goes."""
    return rounded(robust.sigma_clip_converged(spectra(spark, sf_dir), ["fiber"], "flux", 2.0).select("fiber", "idx", "clipped"))


RATIOS = clipped_sql(f"(SELECT fiber, idx, flux / (0.1 + abs(flux) / 10) AS c FROM {SPEC})", 3.0)


@query(
    f"""SELECT fiber % 25 AS x, fiber // 25 AS y, n_kept, {s6('location')} AS sn_location, {s6('mad_std')} AS sn_mad FROM (SELECT fiber, count(c) AS n_kept FROM {RATIOS} GROUP BY 1)
    JOIN {biweight_sql(RATIOS, ['fiber'], 'c')} USING (fiber) JOIN {mad_sql(RATIOS, ['fiber'], 'c')} USING (fiber)"""
)
def agg_clipped_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S/N of every spaxel after clipping to convergence."""
    rows = spectra(spark, sf_dir).withColumn("e", 0.1 + F.abs("flux") / 10)
    rows = rows.withColumn("x", F.col("fiber") % 25).withColumn("y", F.floor(F.col("fiber") / 25))
    return rounded(grid_ops.clipped_stats(rows, "flux", "e", 3.0))


LEVELS = f"""(WITH s AS (SELECT exp, CASE WHEN idx < 24 THEN idx // 6 ELSE 4 + (idx - 24) // 5 END AS chunk, fiber % 4 AS amp, fiber, 1 + abs(flux) AS f FROM {SPEC}),
    m AS (SELECT exp, chunk, median(f) AS mid FROM s GROUP BY 1, 2) SELECT exp, chunk, amp, fiber, x, mid, mid AS y FROM (SELECT exp, chunk, amp, fiber, median(f) AS x FROM s GROUP BY ALL) JOIN m USING (exp, chunk))"""
for _ in range(3):
    LEVELS = f"""(SELECT * EXCLUDE (a) REPLACE (mid * (1 + 0.005 * least(greatest(ceil(round(((x + a) / 2 / mid - 1) / 0.005, 9) - 0.5), -10), 10)) AS y)
        FROM (SELECT *, median(y) OVER (PARTITION BY exp, chunk, amp) AS a FROM {LEVELS}))"""


@query(f"SELECT exp, chunk, amp, fiber, {s6('avg(y) OVER (PARTITION BY exp, chunk, amp ORDER BY fiber ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / mid')} AS ratio FROM {LEVELS}")
def agg_penalised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fiber's level in twelve chunks of bins, held near its amplifier's."""
    rows = spectra(spark, sf_dir).select("exp", "fiber", (F.col("fiber") % 4).alias("amp"), "idx", (1 + F.abs("flux")).alias("f"))
    return rounded(models.penalised_levels(rows, ["exp"], "amp", "fiber", "idx", "f"))


def gaps_sql(src: str, value: str) -> str:
    ahead = "OVER (PARTITION BY exp, col ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    start = f"(SELECT *, CASE WHEN {value} IS NULL AND count(*) FILTER ({value} IS NULL) {ahead} > rest / 3.0 AND rest > 2 THEN row END AS from_ FROM (SELECT *, max(row) OVER (PARTITION BY exp, col) + 1 - row AS rest FROM {src}))"
    return f"(SELECT *, CASE WHEN coalesce(row < first_, true) THEN {value} END AS kept FROM (SELECT *, min(from_) OVER (PARTITION BY exp, col) AS first_ FROM {start}))"


HOLES = f"(SELECT exp, row, col, CASE WHEN flux < 0.08 THEN flux END AS v FROM {GRID})"


@query(f"SELECT exp, row, col, {s6('kept')} AS kept FROM {gaps_sql(HOLES, 'v')}")
def agg_readout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without their bright cells, and without all behind a long gap."""
    rows = grid(spark, sf_dir).select("exp", "row", "col", F.when(F.col("flux") < 0.08, F.col("flux")).alias("v"))
    return rounded(models.readout_gaps(rows, ["exp"], "row", "col", "v").select("exp", "row", "col", "kept"))


def blurred_sql(src: str, sigma: float) -> str:
    """Two passes of a kernel over values v and weights w of a grid."""
    kernel = traces.gaussian_kernel(sigma)
    half = len(kernel) // 2
    for across, along in (("row", "col"), ("col", "row")):
        total = lambda c: " + ".join(f"coalesce({f'lag({c}, {half - j}) OVER t' if j < half else f'lead({c}, {j - half}) OVER t' if j > half else c}, 0) * {k!r}" for j, k in enumerate(kernel))  # noqa: B023, E731
        src = f"(SELECT * REPLACE ({total('v')} AS v, {total('w')} AS w) FROM {src} WINDOW t AS (PARTITION BY exp, {across} ORDER BY {along}))"
    return src


STEPS = f"""(SELECT * EXCLUDE (g), CASE WHEN col = 0 THEN lead(g) OVER t WHEN col = 63 THEN lag(g) OVER t ELSE g END AS g FROM (
    SELECT *, (abs(sky - lag(sky) OVER t) + abs(lead(sky) OVER t - sky)) / 2 AS g FROM (SELECT *, 1 + col % 7 / 10.0 + row / 100.0 AS sky, 0.3 + abs(flux) AS error FROM {GRID}) WINDOW t AS (PARTITION BY exp, row ORDER BY col))
    WINDOW t AS (PARTITION BY exp, row ORDER BY col))"""
SCALED = f"(SELECT exp, row, col, CASE WHEN abs(r) <= 0.5 THEN r END AS r FROM (SELECT *, flux / sqrt(error * error + g * g) AS r FROM {STEPS}))"
LEFT = f"(SELECT exp, row, col, r - v / nullif(w, 0) AS r FROM {blurred_sql(f'(SELECT *, coalesce(r, 0)::DOUBLE AS v, (r IS NOT NULL)::INT::DOUBLE AS w FROM {SCALED})', 7.0)})"


@query(f"SELECT exp, row, col, {s6('kept')} AS residual FROM {gaps_sql(LEFT, 'r')}")
def agg_flat_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals over error and the sky's gradient, without their smooth part and what lies behind gaps."""
    rows = grid(spark, sf_dir).withColumn("sky", 1 + F.col("col") % 7 / 10 + F.col("row") / 100).withColumn("error", 0.3 + F.abs("flux"))
    return rounded(models.flat_residual(rows, ["exp"], "row", "col", "flux", "error", "sky").select("exp", "row", "col", "residual"))


#: Pairs of fibers three rows apart, every 20 rows of a frame.
PAIRED = f"(SELECT exp, p * 2 + k AS fiber, i AS col, 8 + 20 * p + 3 * k + i / 64.0 AS trace FROM (SELECT exp, max(row) + 1 AS n FROM {GRID} GROUP BY 1), range(0, 1000) a(p), range(0, 2) b(k), range(0, 64) c(i) WHERE 20 * p + 20 <= n)"
CHUNK25 = "CASE WHEN col < 42 THEN col // 3 ELSE 14 + (col - 42) // 2 END"
GAPS = f"""(WITH n AS (SELECT exp, max(row) + 1 AS n FROM {GRID} GROUP BY 1), t AS (SELECT *, lead(trace) OVER w AS nxt, row_number() OVER w = 1 AS one FROM {PAIRED} WINDOW w AS (PARTITION BY exp, col ORDER BY fiber)),
    s AS (SELECT exp, fiber AS gap, col, ceil(trace) + 7 AS a, coalesce(ceil(nxt) - 7, n - 4) AS b FROM t JOIN n USING (exp) QUALIFY nxt IS NULL OR max(CASE WHEN col = 32 THEN nxt - trace END) OVER (PARTITION BY exp, fiber) > 10
        UNION ALL SELECT exp, fiber - 1, col, 4, ceil(trace) - 7 FROM t WHERE one)
    SELECT exp, gap, {CHUNK25} AS chunk, avg(col) AS x, avg(row) AS y, median(flux) AS v FROM s JOIN {GRID} USING (exp, col) WHERE row >= a AND row < b GROUP BY 1, 2, 3)"""
NODES = f"""(SELECT exp, gx, gy, n, sum(w * v) / nullif(sum(w), 0) AS v FROM (SELECT exp, n, gx, gy, v, exp(-0.5 * (pow(x - gx * 63 / 24.0, 2) + pow(y - gy * (n - 1) / 24.0, 2)) / 22500.0) AS w
    FROM {GAPS} JOIN (SELECT exp, max(row) + 1 AS n FROM {GRID} GROUP BY 1) USING (exp), range(0, 25) a(gx), range(0, 25) b(gy)) GROUP BY 1, 2, 3, 4)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = grid(spark, sf_dir).groupBy("exp").agg((F.max("row") + 1).alias("n")).where("n >= 20")
    rows = size.withColumn("p", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 20) / 20).cast("int")))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.select("exp", (F.col("p") * 2 + F.col("k")).alias("fiber"), "col", (8 + 20 * F.col("p") + 3 * F.col("k") + F.col("col") / 64).alias("trace"))


@query(
    f"""WITH g AS (SELECT * FROM {NODES}), p AS (SELECT f.exp, row, col, col * 24 / 63.0 AS fx, row * 24.0 / (n - 1) AS fy FROM {GRID} f JOIN (SELECT DISTINCT exp, n FROM g) USING (exp)),
    c AS (SELECT *, least(floor(fx), 23)::BIGINT AS cx, least(floor(fy), 23)::BIGINT AS cy FROM p)
    SELECT c.exp, row, col, {s6('a.v * (1 - fx + cx) * (1 - fy + cy) + b.v * (fx - cx) * (1 - fy + cy) + d.v * (1 - fx + cx) * (fy - cy) + e.v * (fx - cx) * (fy - cy)')} AS scattered FROM c
    JOIN g a ON a.exp = c.exp AND a.gx = cx AND a.gy = cy JOIN g b ON b.exp = c.exp AND b.gx = cx + 1 AND b.gy = cy JOIN g d ON d.exp = c.exp AND d.gx = cx AND d.gy = cy + 1 JOIN g e ON e.exp = c.exp AND e.gx = cx + 1 AND e.gy = cy + 1"""
)
def fit_scattered_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth light of every pixel, from the gaps between pairs of fibers."""
    frame = grid(spark, sf_dir).select("exp", "row", "col", "flux")
    return rounded(models.scattered_light(frame, paired(spark, sf_dir), ["exp"], "flux", 32).select("exp", "row", "col", "scattered").where("scattered is not null"))


@query(
    f"""WITH s AS (SELECT t.exp, f.row - t.t AS o, f.flux / t.f AS v FROM (SELECT exp, idx AS col, {TRACE} AS t, 20 + abs(flux) AS f FROM {ORDERED}) t JOIN {FLAT} f ON f.exp = t.exp AND f.col = t.col AND f.row BETWEEN ceil(t.t - 6) AND floor(t.t + 6))
    SELECT exp, chunk, {s6('median(o)')} AS x, {s6('median(v)')} AS y FROM (SELECT *, ntile(25) OVER (PARTITION BY exp ORDER BY o, v) - 1 AS chunk FROM s) GROUP BY 1, 2"""
)
def agg_stacked_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light across the fibers of each exposure, from all their pixels in order of offset."""
    rows = spectra(spark, sf_dir).withColumn("rw", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    trace = rows.select("exp", F.col("rw").alias("fiber"), F.col("idx").alias("col"), F.expr(TRACE).alias("trace"))
    flux = rows.select("exp", F.col("rw").alias("fiber"), F.col("idx").alias("col"), (20 + F.abs("flux")).alias("f"))
    samples = models.profile_samples(flat_frame(spark, sf_dir), trace, flux, ["exp"], "flux", "f")
    return rounded(models.stacked_profile(samples, ["exp"], "offset", "share"))


WAVES = "0.01 * idx + 0.02 * rw + rw * rw / 10000.0"
SURFACE = f"(SELECT exp, idx AS col, {TRACE} AS x, {WAVES} AS y FROM {ORDERED} UNION ALL SELECT DISTINCT exp, col, row, NULL FROM {GRID})"


@query(f"SELECT exp, x::BIGINT AS row, col, round(m, 4) + 0.0 AS surface FROM {poly_sql(SURFACE, ['exp', 'col'], 'x', 'y', 7, 'm')} WHERE y IS NULL")
def fit_column_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of every pixel of a frame: in each column a polynomial of degree 7 through the fibers' values."""
    rows = spectra(spark, sf_dir).withColumn("rw", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    points = rows.select("exp", F.col("idx").alias("col"), F.expr(TRACE).alias("x"), F.expr(WAVES).alias("y"))
    out = models.column_surface(points, grid(spark, sf_dir).select("exp", "row", "col"), ["exp"], "x", "y")
    return out.withColumn("surface", F.round("surface", 4) + F.lit(0.0))


@query(
    f"""WITH g AS (SELECT exp, row, col, CASE WHEN flux < 0.05 THEN flux END AS v FROM {GRID}),
    f AS (SELECT h.exp, h.row, h.col, arg_min(s.v, [pow(s.row - h.row, 2) + pow(s.col - h.col, 2), s.row, s.col]) AS fill FROM g h JOIN g s ON s.exp = h.exp AND s.v IS NOT NULL AND h.v IS NULL GROUP BY 1, 2, 3)
    SELECT exp, row, col, {s6('coalesce(v, fill)')} AS filled FROM g LEFT JOIN f USING (exp, row, col)"""
)
def win_nearest_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose bright cells take the value of the nearest other cell."""
    rows = grid(spark, sf_dir).select("exp", "row", "col", F.when(F.col("flux") < 0.05, F.col("flux")).alias("v"))
    return rounded(models.nearest_filled(rows, ["exp"], "row", "col", "v").select("exp", "row", "col", "filled"))
