"""Robust statistics and calibration over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, robust
from .registry import SPEC, biweight_sql, mad_sql, query, r6, rounded, s6, spectra, table

LINES = "(SELECT l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_orderkey FROM lineitem)"


@query(f"SELECT l_suppkey, {s6('location')} AS location, {s6('scale')} AS scale FROM {biweight_sql('lineitem', ['l_suppkey'], 'l_extendedprice')}")
def rob_biweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.biweight(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"))


@query(f"SELECT l_suppkey, l_linenumber, {s6('mad_std')} AS mad_std FROM {mad_sql('lineitem', ['l_suppkey', 'l_linenumber'], 'l_extendedprice')}")
def rob_mad_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.mad_std(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], "l_extendedprice"))


@query(f"SELECT l_suppkey, {s6('median(l_extendedprice)')} AS price, {s6('median(l_quantity)')} AS quantity FROM lineitem GROUP BY 1")
def rob_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(robust.medians(table(spark, sf_dir, "lineitem"), ["l_suppkey"], price="l_extendedprice", quantity="l_quantity"))


@query(
    f"""SELECT l_suppkey, count(*) AS n, count(c) AS kept, {s6('sum(c)')} AS total FROM (
    SELECT l_suppkey, CASE WHEN l_extendedprice BETWEEN quantile_cont(l_extendedprice, 0.02) OVER w AND quantile_cont(l_extendedprice, 0.98) OVER w
    THEN l_extendedprice END AS c FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) GROUP BY 1"""
)
def rob_percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.percentile_clip(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return rounded(out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("clipped").alias("kept"), F.sum("clipped").alias("total")))


def clip_sql(src: str, keys: str, x: str, n: float, rounds: int) -> str:
    now = f"(SELECT *, {x} AS c FROM {src})"
    for _ in range(rounds):
        now = (
            f"(SELECT * EXCLUDE (m, s, c), CASE WHEN c - m >= -{n} * s AND c - m <= {n} * s THEN c END AS c FROM (SELECT *, 1.4826 * median(abs(c - m)) OVER (PARTITION BY {keys}) AS s "
            f"FROM (SELECT *, median(c) OVER (PARTITION BY {keys}) AS m FROM {now})))"
        )
    return now


@query(f"SELECT fiber, {s6('avg(c)')} AS mean, count(c) AS kept FROM {clip_sql(SPEC, 'fiber', 'flux', 2.5, 3)} GROUP BY 1")
def rob_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = robust.sigma_clip(spectra(spark, sf_dir), ["fiber"], "flux", 2.5)
    return rounded(out.groupBy("fiber").agg(F.avg("clipped").alias("mean"), F.count("clipped").alias("kept")))


SUB = f"(SELECT * FROM {SPEC} WHERE idx BETWEEN 16 AND 47)"
LEVELS = f"(SELECT exp, fiber, level FROM {biweight_sql(SUB, ['exp', 'fiber'], 'flux', loc='level')})"


def sky_sql(levels: str, keys: str = "exp") -> str:
    return f"""(SELECT l.*, coalesce(l.level - lvl < 2 * scale, false) AS is_sky FROM {levels} l LEFT JOIN (SELECT {keys}, lvl, scale FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, i) AS r FROM (
    SELECT g.{keys}, i, lvl, scale, count(*) FILTER (abs(l.level - lvl) < scale) AS n FROM (
    SELECT e.{keys}, i, p5 + (p60 - p5) * i / 80 AS lvl, b.scale FROM
    (SELECT {keys}, quantile_cont(level, 0.05) AS p5, quantile_cont(level, 0.6) AS p60 FROM {levels} GROUP BY 1) e
    JOIN {biweight_sql(levels, [keys], 'level')} b USING ({keys}), range(0, 81) r(i)) g JOIN {levels} l USING ({keys}) GROUP BY ALL)) WHERE r = 1) USING ({keys}))"""


@query(f"SELECT exp, fiber, {s6('level')} AS level, is_sky FROM {sky_sql(LEVELS)}")
def rob_sky_fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = spectra(spark, sf_dir).where("idx between 16 and 47")
    levels = robust.biweight(window, ["exp", "fiber"], "flux", loc="level", scale=None)
    return rounded(robust.sky_fibers(levels, ["exp"], "level"))


SKY = f"(SELECT exp, idx, sky FROM {biweight_sql(f'(SELECT s.* FROM {SPEC} s SEMI JOIN (SELECT * FROM {sky_sql(LEVELS)} WHERE is_sky) k USING (exp, fiber))', ['exp', 'idx'], 'flux', loc='sky')})"


def sky_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.exposure_sky(spectra(spark, sf_dir), "exp", "fiber", "idx", "flux", 16, 48)


@query(f"SELECT exp, idx, {s6('sky')} AS sky FROM {SKY}")
def agg_exposure_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sky_of(spark, sf_dir))


@query(f"SELECT s.fiber, s.exp, s.idx, {s6('s.flux - k.sky')} AS residual FROM {SPEC} s JOIN {SKY} k USING (exp, idx)")
def sky_subtracted_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sky spectrum of each exposure, and every fiber's spectrum without it."""
    out = calibrate.subtract_sky(spectra(spark, sf_dir), sky_of(spark, sf_dir), "exp", "idx", "flux")
    return out.select("fiber", "exp", "idx", r6("residual").alias("residual"))


@query(f"SELECT a.exp, {s6('median(a.sky / nullif(b.sky, 0))')} AS ratio FROM {SKY} a JOIN (SELECT idx, sky FROM {SKY} WHERE exp = 0) b USING (idx) GROUP BY 1")
def agg_sky_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.sky_ratio(sky_of(spark, sf_dir), "exp", "idx", 0))


@query(
    f"""SELECT l_suppkey, l_linenumber, {s6('median(l_extendedprice)')} AS master, {s6('1.4826 * median(abs(d))')} AS scatter FROM (
    SELECT *, l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_suppkey, l_linenumber) AS d FROM lineitem) GROUP BY 1, 2"""
)
def agg_master_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.master_frame(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"], "l_extendedprice"))


@query(
    f"""SELECT l_suppkey, {s6('sum(m)')} AS master, {s6('avg(s)')} AS scatter FROM (SELECT l_suppkey, l_linenumber, median(l_extendedprice) AS m, 1.4826 * median(abs(d)) AS s FROM (
    SELECT *, l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_suppkey, l_linenumber) AS d FROM lineitem) GROUP BY 1, 2) GROUP BY 1"""
)
def agg_arc_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.arc_master(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_extendedprice"))


@query(f"SELECT event_type, round((epoch(arg_min(ts, event_id)) + epoch(arg_max(ts, event_id))) / 2, 3) AS mean_time FROM events GROUP BY 1")
def agg_mean_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.mean_time(table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id").withColumn("mean_time", F.round("mean_time", 3))


@query(
    f"""WITH l AS (SELECT exp, fiber, median(flux) AS lv FROM {SPEC} GROUP BY 1, 2) SELECT exp, idx, {s6('r * a')} AS twilight FROM
    (SELECT exp, idx, median(flux / nullif(lv, 0)) AS r FROM {SPEC} JOIN l USING (exp, fiber) GROUP BY 1, 2) JOIN (SELECT exp, median(lv) AS a FROM l GROUP BY 1) USING (exp)"""
)
def agg_scaled_twilight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.scaled_twilight(spectra(spark, sf_dir), ["exp"], "fiber", "idx", "flux"))


@query(f"SELECT exp, {s6('read_noise')} AS read_noise FROM {biweight_sql(mad_sql(SPEC, ['exp', 'idx'], 'flux'), ['exp'], 'mad_std', loc='read_noise')}")
def agg_read_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.read_noise(spectra(spark, sf_dir), ["exp"], "idx", "flux"))


@query(f"SELECT s.fiber, s.exp, s.idx, {s6('flux - lv')} AS cleaned FROM {SPEC} s JOIN {biweight_sql(SPEC, ['exp', 'idx'], 'flux', loc='lv')} USING (exp, idx)")
def agg_residual_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibrate.residual_map(spectra(spark, sf_dir), ["exp", "idx"], "flux")
    return rounded(out.select("fiber", "exp", "idx", "cleaned"))


ERR = f"(SELECT *, 0.1 + abs(flux) / 10 AS error, flux / (0.1 + abs(flux) / 10) AS ratio FROM {SPEC})"


def with_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("error", 0.1 + F.abs("flux") / 10)


@query(f"SELECT exp, {s6('median(scale)')} AS factor, median(scale) - 1 >= -0.3 AS kept FROM {biweight_sql(ERR, ['exp', 'idx'], 'ratio')} GROUP BY 1")
def agg_error_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.error_factor(with_error(spark, sf_dir), ["exp"], "idx", "flux", "error"))


@query(f"SELECT exp, {s6('noise_ratio')} AS noise_ratio FROM {mad_sql(ERR, ['exp'], 'ratio', 'noise_ratio')}")
def agg_noise_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.noise_ratio(with_error(spark, sf_dir), ["exp"], "flux", "error"))


@query(f"SELECT fiber % 20 AS cell, idx, {s6('sum(flux / (error * error)) / sum(1 / (error * error))')} AS flux, {s6('sqrt(1 / sum(1 / (error * error)))')} AS error FROM {ERR} GROUP BY 1, 2")
def agg_coadd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_error(spark, sf_dir).withColumn("cell", F.col("fiber") % 20)
    return rounded(calibrate.coadd(df, ["cell", "idx"], "flux", "error"))


@query(
    f"""SELECT source, idx, CASE WHEN NOT bad THEN {s6('f')} END AS flux, CASE WHEN NOT bad THEN {s6('e')} END AS error, {s6('w')} AS weight FROM (
    SELECT *, max((w < 0.05)::INT) OVER (PARTITION BY source ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS bad FROM (
    SELECT fiber % 20 AS source, idx, sum(flux * g) / nullif(sum(g * g), 0) AS f, sqrt(sum(g * error * error) / nullif(sum(g * g), 0)) AS e, sum(g) AS w
    FROM (SELECT *, CASE WHEN idx % 9 = 0 THEN 0.001 ELSE 1.0 / (1 + fiber) END AS g FROM {ERR}) GROUP BY 1, 2))"""
)
def agg_weighted_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("idx") % 9 == 0, 0.001).otherwise(1.0 / (1 + F.col("fiber")))
    df = with_error(spark, sf_dir).withColumn("source", F.col("fiber") % 20).withColumn("g", g)
    return rounded(calibrate.weighted_extract(df, "source", "idx", "flux", "error", "g"))


@query(
    f"""SELECT user_id, {s6("coalesce(median(value) FILTER (event_type = 'click'), 1.0)")} AS clicks, {s6("coalesce(median(value) FILTER (event_type = 'purchase' AND value > 90), 0.5)")} AS buys
    FROM events GROUP BY 1"""
)
def agg_guide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return rounded(calibrate.guide_summary(ev, ["user_id"], clicks=("value", "event_type = 'click'", 1.0), buys=("value", "event_type = 'purchase' and value > 90", 0.5)))


@query(
    f"""WITH a AS (SELECT exp, fiber, idx, flux, max((coalesce(chi > 2.0, false))::INT) OVER (PARTITION BY exp, fiber ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c, ftf
    FROM (SELECT *, abs(flux) * 10 AS chi, 0.25 + (fiber % 40) / 20.0 AS ftf FROM {SPEC})),
    b AS (SELECT *, CASE WHEN c = 1 OR ftf < 0.3 OR flux IS NULL OR flux = 0 THEN 1 ELSE 0 END AS m FROM a),
    d AS (SELECT * EXCLUDE (m), CASE WHEN sum(m) OVER (PARTITION BY exp, fiber) > 20 THEN 1 ELSE m END AS m FROM b),
    e AS (SELECT * EXCLUDE (m), CASE WHEN sum(m) OVER w > 0.4 * count(m) OVER w THEN 1 ELSE m END AS m FROM d WINDOW w AS (PARTITION BY exp, idx)),
    f AS (SELECT exp, avg(m) > 0.4 AS amp FROM e GROUP BY 1)
    SELECT exp, fiber, count(*) FILTER (m = 1 OR amp) AS masked FROM e JOIN f USING (exp) GROUP BY 1, 2"""
)
def agg_mask_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spectra(spark, sf_dir).withColumn("chi", F.abs("flux") * 10).withColumn("ftf", 0.25 + (F.col("fiber") % 40) / 20.0)
    out = calibrate.mask_cascade(df, "exp", "fiber", "idx", "flux", "chi", "ftf", most_chi2=2.0, most_bins=20, share=0.4)
    return out.groupBy("exp", "fiber").agg(F.count(F.when(F.col("masked"), 1)).alias("masked"))


BINNED = "(SELECT *, 1 + CAST(floor((l_quantity - 0.5) / 5) AS INT) AS bin FROM lineitem)"


@query(f"SELECT bin, {s6('wave')} AS wave, {s6('flux')} AS flux FROM {biweight_sql(BINNED, ['bin'], 'l_extendedprice', loc='flux')} JOIN (SELECT bin, avg(l_quantity) AS wave FROM {BINNED} GROUP BY 1) USING (bin)")
def agg_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibrate.template(table(spark, sf_dir, "lineitem"), [], "l_quantity", "l_extendedprice", 0.5, 50.5, 10))


@query(
    f"""WITH r AS (SELECT l_linenumber AS exp, l_extendedprice / nullif(median(l_extendedprice) OVER (PARTITION BY l_suppkey), 0) AS rel FROM lineitem),
    m AS (SELECT *, median(rel) OVER (PARTITION BY exp) AS mid FROM r) SELECT exp, {s6('median(rel)')} AS factor, count(*) AS n_stars FROM m WHERE abs(rel - mid) < 0.15 GROUP BY 1"""
)
def agg_star_zero_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "exp")
    return rounded(calibrate.star_zero_point(li, "l_suppkey", "exp", "l_extendedprice"))
