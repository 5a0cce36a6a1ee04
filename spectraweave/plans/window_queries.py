"""Ordered-sample operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import arrays, windows
from .registry import SPEC, biweight_sql, query, rounded, s6, spectra, table
from .sql_tools import apart_sql


@query(
    f"""SELECT fiber, idx, {s6('flux')} AS flux, {s6('idx - (b - a) / (2 * (b - 2 * flux + a))')} AS peak FROM (
    SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS b FROM {SPEC} WINDOW w AS (PARTITION BY fiber ORDER BY idx)) WHERE flux > a AND flux > b AND flux > 0.1"""
)
def win_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.local_peaks(spectra(spark, sf_dir), ["fiber"], "idx", "flux", 0.1).select("fiber", "idx", "flux", "peak"))


VOX = f"(SELECT fiber % 25 AS x, fiber // 25 AS y, idx AS z, flux AS v FROM {SPEC})"


@query(
    f"""WITH v AS (SELECT * FROM {VOX}) SELECT a.x, a.y, a.z, {s6('a.v')} AS v FROM v a JOIN v b ON abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND abs(b.z - a.z) <= 1
    WHERE a.v > 0.2 GROUP BY a.x, a.y, a.z, a.v HAVING a.v >= max(b.v)"""
)
def win_local_maxima_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = spectra(spark, sf_dir).select((F.col("fiber") % 25).alias("x"), F.floor(F.col("fiber") / 25).alias("y"), F.col("idx").alias("z"), F.col("flux").alias("v"))
    return rounded(windows.local_maxima_3d(vox, ("x", "y", "z"), "v", 0.2))


@query(f"SELECT fiber, idx, max((flux > 0.25)::INT) OVER (PARTITION BY fiber ORDER BY idx RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS dilated FROM {SPEC}")
def win_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir).withColumn("m", F.col("flux") > 0.25)
    return windows.dilate(df, ["fiber"], "idx", "m", 3).select("fiber", "idx", "dilated")


@query(f"SELECT fiber, idx, {s6('quantile_cont(flux, 0.5) OVER (PARTITION BY fiber ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)')} AS running FROM {SPEC}")
def win_running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.running_percentile(spectra(spark, sf_dir), ["fiber"], "idx", "flux", 17).select("fiber", "idx", "running"))


@query(f"SELECT fiber, idx, {s6('quantile_cont(flux, 0.25) OVER (PARTITION BY fiber ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)')} AS running FROM {SPEC}")
def win_running_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.running_percentile(spectra(spark, sf_dir), ["fiber"], "idx", "flux", 41, 0.25).select("fiber", "idx", "running"))


@query(
    f"""SELECT a.fiber, a.idx, {s6('median(b.flux)')} AS running FROM {SPEC} a JOIN {SPEC} b ON a.exp = b.exp AND b.fiber BETWEEN a.fiber - 30 AND a.fiber + 30
    AND b.idx BETWEEN a.idx - 1 AND a.idx + 1 GROUP BY 1, 2"""
)
def win_running_median_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.running_median_2d(spectra(spark, sf_dir), ["exp"], "fiber", "idx", "flux", 30, 1).select("fiber", "idx", "running"))


KERNEL = [0.05, 0.25, 0.4, 0.25, 0.05]

def smooth_sql(error: bool) -> str:
    cols = ", ".join(f"lag(f, {2 - j}) OVER w AS v{j}" if j < 2 else f"lead(f, {j - 2}) OVER w AS v{j}" for j in range(5))
    weight = " + ".join(f"(CASE WHEN v{j} IS NOT NULL THEN {k} ELSE 0 END)" for j, k in enumerate(KERNEL))
    total = " + ".join(f"coalesce(v{j} * v{j} * {k * k!r}, 0)" if error else f"coalesce(v{j} * {k}, 0)" for j, k in enumerate(KERNEL))
    value = f"sqrt({total}) / nullif({weight}, 0)" if error else f"({total}) / nullif({weight}, 0)"
    src = f"(SELECT fiber, idx, CASE WHEN abs(flux) >= 0.02 THEN flux END AS f FROM {SPEC})"
    return f"SELECT fiber, idx, {s6(value)} AS smoothed FROM (SELECT fiber, idx, {cols} FROM {src} WINDOW w AS (PARTITION BY fiber ORDER BY idx))"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("f", F.when(F.abs("flux") >= 0.02, F.col("flux")))


@query(smooth_sql(False))
def win_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.smooth(holed(spark, sf_dir), ["fiber"], "idx", "f", KERNEL).select("fiber", "idx", "smoothed"))


@query(smooth_sql(True))
def win_smooth_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.smooth(holed(spark, sf_dir), ["fiber"], "idx", "f", KERNEL, error=True).select("fiber", "idx", "smoothed"))


@query(f"SELECT fiber, c AS chunk, {s6('median(flux)')} AS level, count(*) AS n FROM (SELECT *, ntile(9) OVER (PARTITION BY fiber ORDER BY idx) - 1 AS c FROM {SPEC}) GROUP BY 1, 2")
def win_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.chunk(spectra(spark, sf_dir), ["fiber"], "idx", 9)
    return rounded(out.groupBy("fiber", "chunk").agg(F.percentile("flux", 0.5).alias("level"), F.count("*").alias("n")))


@query(
    """SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 7200000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2"""
)
def win_session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.session_groups(table(spark, sf_dir, "events"), ["user_id"], "ts", 7200, "event_id")
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    """SELECT o_custkey, block, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY d ROWS UNBOUNDED PRECEDING) AS block FROM (
    SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) > 1 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT o_custkey, o_orderkey // 400 AS d FROM orders))) GROUP BY 1, 2"""
)
def win_number_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 400).alias("d")).distinct()
    return windows.number_groups(o, ["o_custkey"], "d").groupBy("o_custkey", "block").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def win_first_per(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return windows.first_per(ev, ["user_id", "day"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    f"""SELECT l_orderkey, l_linenumber, {s6('coalesce(l_extendedprice - lag(l_extendedprice) OVER w, lead(l_extendedprice) OVER w - l_extendedprice)')} AS width
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)"""
)
def win_bin_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return rounded(windows.bin_widths(li, ["l_suppkey"], "at", "l_extendedprice").select("l_orderkey", "l_linenumber", "width"))


@query(
    f"""WITH h AS (SELECT fiber, idx, CASE WHEN abs(flux) < 0.15 THEN flux END AS f FROM {SPEC}),
    g AS (SELECT *, max(CASE WHEN f IS NOT NULL THEN idx END) OVER (PARTITION BY fiber ORDER BY idx ROWS UNBOUNDED PRECEDING) AS a,
    min(CASE WHEN f IS NOT NULL THEN idx END) OVER (PARTITION BY fiber ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM h)
    SELECT g.fiber, g.idx, {s6('coalesce(g.f, ha.f + (hb.f - ha.f) * (g.idx - a) / nullif(b - a, 0), ha.f, hb.f)')} AS filled
    FROM g LEFT JOIN h ha ON ha.fiber = g.fiber AND ha.idx = a LEFT JOIN h hb ON hb.fiber = g.fiber AND hb.idx = b"""
)
def win_interpolate_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir).withColumn("f", F.when(F.abs("flux") < 0.15, F.col("flux")))
    return rounded(windows.interpolate_masked(df, ["fiber"], "idx", "f").select("fiber", "idx", "filled"))


RISING = f"""(SELECT fiber, flux, idx - (b - a) / (2 * (b - 2 * flux + a)) AS peak FROM (SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS b FROM {SPEC} WINDOW w AS (PARTITION BY fiber ORDER BY idx))
    WHERE flux > a AND flux > b AND flux > 0.05)"""


@query(f"SELECT fiber, {s6('peak')} AS peak, {s6('flux')} AS flux FROM {apart_sql(RISING, 'fiber', 'peak', 'flux', 8.0, 5)}")
def win_suppress_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = windows.local_peaks(spectra(spark, sf_dir), ["fiber"], "idx", "flux", 0.05)
    return rounded(windows.suppress_close(peaks, ["fiber"], "peak", "flux", 8.0, 5))


@query(f"SELECT fiber, idx, {s6('flux')} AS flux FROM {SPEC} QUALIFY row_number() OVER (PARTITION BY fiber ORDER BY flux DESC, idx) <= 4")
def win_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.top_n(spectra(spark, sf_dir), ["fiber"], 4, F.desc("flux"), "idx").select("fiber", "idx", "flux"))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {s6('sum(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) / sum(l_extendedprice) OVER (PARTITION BY l_suppkey)')} AS growth
    FROM lineitem"""
)
def win_curve_of_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.curve_of_growth(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "growth"))


@query(
    f"""WITH k AS (SELECT exp, fiber, idx, flux * 10 AS y FROM {SPEC} WHERE idx % 3 <> 1), g AS (SELECT DISTINCT exp, fiber FROM {SPEC}),
    p AS (SELECT exp, fiber, q * 0.75 AS at_ FROM g, range(0, 90) r(q)),
    n AS (SELECT p.exp, p.fiber, at_, (SELECT max(idx) FROM k WHERE k.fiber = p.fiber AND idx <= at_) AS a, (SELECT min(idx) FROM k WHERE k.fiber = p.fiber AND idx >= at_) AS b FROM p)
    SELECT n.fiber, at_ AS place, {s6('ka.y + (kb.y - ka.y) * coalesce((at_ - a) / nullif(b - a, 0), 0)')} AS y,
    {s6('sqrt(pow((0.1 + abs(ka.y)) * (1 - coalesce((at_ - a) / nullif(b - a, 0), 0)), 2) + pow((0.1 + abs(kb.y)) * coalesce((at_ - a) / nullif(b - a, 0), 0), 2))')} AS e
    FROM n LEFT JOIN k ka ON ka.fiber = n.fiber AND ka.idx = a LEFT JOIN k kb ON kb.fiber = n.fiber AND kb.idx = b"""
)
def arr_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir).withColumn("y", F.when(F.col("idx") % 3 != 1, F.col("flux") * 10)).withColumn("e", 0.1 + F.abs("y"))
    grid = spark.range(90).select((F.col("id") * 0.75).alias("place"))
    return rounded(arrays.rectify(df, ["fiber"], "idx", "y", grid, at="place", error="e"))


@query(f"SELECT fiber, CAST(list(flux ORDER BY idx) AS DOUBLE[]) AS flux FROM (SELECT fiber, idx, {s6('flux * 2')} AS flux FROM {SPEC}) GROUP BY 1")
def arr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rounded(spectra(spark, sf_dir).withColumn("flux", F.col("flux") * 2))
    return arrays.to_array(df, ["fiber"], ["flux"], i="idx")


@query(f"SELECT exp, fiber // 4 AS fiber, idx // 4 AS idx, {s6('avg(flux)')} AS flux FROM {SPEC} GROUP BY 1, 2, 3")
def arr_block_rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.block_rebin(spectra(spark, sf_dir), ["exp"], "fiber", "idx", "flux", 4))


PARTS = f"(SELECT *, ntile(8) OVER (PARTITION BY fiber ORDER BY idx) AS c FROM {SPEC})"


@query(
    f"""WITH k AS (SELECT fiber, c, avg(idx) AS a, any_value(lv) AS lv FROM {PARTS} JOIN {biweight_sql(PARTS, ['fiber', 'c'], 'flux', loc='lv')} USING (fiber, c) GROUP BY 1, 2),
    s AS (SELECT *, lead(a) OVER w AS a2, lead(lv) OVER w AS lv2, row_number() OVER w = 1 AS one FROM k WINDOW w AS (PARTITION BY fiber ORDER BY a))
    SELECT fiber, idx, {s6('lv + coalesce((lv2 - lv) * greatest(0, (idx - a) / (a2 - a)), 0)')} AS continuum FROM {SPEC} JOIN s USING (fiber) WHERE (one OR idx >= a) AND (a2 IS NULL OR idx < a2)"""
)
def arr_continuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(arrays.continuum(spectra(spark, sf_dir), ["fiber"], "idx", "flux", 8).select("fiber", "idx", "continuum"))


@query(f"SELECT fiber, CASE WHEN f > 0 THEN {s6('-2.5 * log10(f) + 23.9')} END AS mag FROM (SELECT fiber, sum((flux + 0.2) * (idx + 1)) / sum(idx + 1) AS f FROM {SPEC} GROUP BY 1)")
def arr_synthetic_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fiber"), F.transform("embedding", lambda x: x.cast("double") + 0.2).alias("s"), F.transform("embedding", lambda x, i: (i + 1).cast("double")).alias("r")
    )
    return rounded(e.select("fiber", arrays.synthetic_mag("s", "r").alias("mag")))


ROWS = f"(SELECT *, row_number() OVER (PARTITION BY exp, idx ORDER BY fiber) - 1 AS rw FROM {SPEC})"
SHARE = "greatest(0, least(f.rw + 0.5, trace + 2.5) - greatest(f.rw - 0.5, trace - 2.5))"


@query(
    f"""WITH f AS (SELECT * FROM {ROWS}), n AS (SELECT exp, max(rw) AS last FROM f GROUP BY 1), t AS (SELECT exp, rw AS fiber, idx, (rw * (last - 1))::DOUBLE / (last + 1) + 1 + (idx % 10)::DOUBLE / 10 AS trace FROM f JOIN n USING (exp))
    SELECT t.exp, t.fiber, t.idx AS col, {s6(f'CASE WHEN any_value(floor(trace - 2) >= 0 AND floor(trace + 3) <= last) THEN sum(flux * {SHARE}) / 5 ELSE 0 END')} AS flux,
    {s6(f'CASE WHEN any_value(floor(trace - 2) >= 0 AND floor(trace + 3) <= last) THEN sqrt(sum(pow((0.1 + abs(flux)) * {SHARE}, 2))) / 5 ELSE 0 END')} AS error
    FROM t JOIN n USING (exp) LEFT JOIN f ON f.exp = t.exp AND f.idx = t.idx AND f.rw BETWEEN trace - 4 AND trace + 4 GROUP BY 1, 2, 3"""
)
def arr_aperture_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).withColumn("row", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    frame = rows.select("exp", "row", F.col("idx").alias("col"), "flux", (0.1 + F.abs("flux")).alias("error"))
    n = F.max("row").over(Window.partitionBy("exp")) + 1
    trace = rows.select("exp", F.col("row").alias("fiber"), F.col("idx").alias("col"), (F.col("row") * (n - 2) / n + 1 + F.col("idx") % 10 / 10).alias("trace"))
    return rounded(arrays.aperture_extract(frame, trace, ["exp"], "flux", "error"))
