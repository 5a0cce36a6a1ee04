"""Amplifier and fiber models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import amps
from .join_queries import PLANE
from .registry import SPEC, biweight_sql, mad_sql, positions, query, rounded, s6, spectra, table
from .sql_tools import poly_sql, terms_sql, tukey_terms_sql
from .robust_queries import clip_sql

FIXES = [("1994-01-01", "1995-06-01", 24, 15), ("1994-01-01", "1995-06-01", 15, 24), ("1996-01-14", "1996-08-28", 7, 9)]


@query(
    """SELECT o_orderkey, CASE WHEN d > DATE '1994-01-01' AND d < DATE '1995-06-01' AND slot = 24 THEN 15 WHEN d > DATE '1994-01-01' AND d < DATE '1995-06-01' AND slot = 15 THEN 24
    WHEN d > DATE '1996-01-14' AND d < DATE '1996-08-28' AND slot = 7 THEN 9 ELSE slot END AS slot FROM (SELECT o_orderkey, o_custkey % 30 AS slot, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def prj_dated_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", amps.dated_identity(F.col("o_custkey") % 30, F.col("o_orderdate").cast("date"), FIXES).alias("slot"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R'")
def prj_same_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amps.same_unit(table(spark, sf_dir, "lineitem"), spectrograph=("l_linenumber", 3), controller=("l_returnflag", "R")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_returnflag = 'A' AND l_discount <> 0 AND l_tax <> 0")
def prj_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return amps.catalog_rows(li, "l_returnflag", "A", "l_discount", "l_tax").select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 250 OFFSET 100")
def srt_index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amps.index_slice(table(spark, sf_dir, "orders"), 100, 350, "o_orderdate", "o_orderkey").select("o_orderkey")


@query(
    f"""SELECT label, count(*) FILTER (abs(px) <= 40 AND abs(py) <= 40) AS n, CASE WHEN count(*) FILTER (abs(px) <= 40 AND abs(py) <= 40) = 0 THEN 'empty'
    WHEN count(*) FILTER (abs(px) <= 40 AND abs(py) <= 40) < 20 THEN 'low' END AS warning FROM {PLANE} JOIN embeddings USING (vec_id) GROUP BY 1"""
)
def jn_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amps.in_region(positions(spark, sf_dir), "label", F.lit(150.0), F.lit(2.0), 40.0, 20)[1]


@query(
    """SELECT e.vec_id, n.n_name, len(list_filter(e.embedding, lambda x: abs(x) * 10 < 0.8)) AS n_null FROM embeddings e JOIN nation n ON n.n_nationkey % 10 = e.label AND n.n_nationkey // 10 = e.vec_id % 3"""
)
def jn_survey_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.format_string("202401%02d_%03d", F.col("label") + 10, F.col("vec_id") % 3).alias("shot"), "embedding", F.transform("embedding", lambda x: F.abs(x) * 10).alias("w")
    )
    n = table(spark, sf_dir, "nation").select("n_name", F.format_string("202401%02d", F.col("n_nationkey") % 10 + 10).alias("date"), F.floor(F.col("n_nationkey") / 10).cast("int").alias("obs"))
    out = amps.survey_spectra(e, n, "shot", "w", "embedding")
    return out.select("vec_id", "n_name", F.size(F.filter("embedding", lambda x: x.isNull())).cast("long").alias("n_null"))


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN NOT (l_tax > 0.05 AND l_quantity / 50 > 0.5) THEN {s6('l_extendedprice * (1 + l_discount) / (1 + l_linenumber) * 1.1 - l_quantity / (1 + l_linenumber)')} END AS applied FROM lineitem"""
)
def prj_applied_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumns(
        {"a": 1 + F.col("l_discount"), "m": 1.0 + F.col("l_linenumber"), "f": F.lit(1.1), "z": F.col("l_quantity") / 50}
    )
    out = amps.applied_factors(li, "l_suppkey", "l_linenumber", "l_extendedprice", "a", "m", "f", "l_quantity", "l_tax", "z", most=0.05)
    return rounded(out.select("l_orderkey", "l_linenumber", "applied"))


@query(f"SELECT fiber, {s6('1.4826 * median(abs(d))')} AS rms, count(*) AS n FROM (SELECT fiber, r - median(r) OVER (PARTITION BY fiber) AS d FROM (SELECT fiber, flux - idx / 64.0 AS r FROM {SPEC} WHERE flux <> 0)) GROUP BY 1")
def agg_trace_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    return rounded(amps.trace_rms(s, s.select("fiber", "idx", (F.col("idx") / 64).alias("fit")), ["fiber"], "idx", "flux", "fit"))


LEVELS = f"(SELECT exp, fiber % 4 AS amp, fiber, median(flux) AS level FROM {SPEC} GROUP BY 1, 2, 3)"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).groupBy("exp", (F.col("fiber") % 4).alias("amp"), "fiber").agg(F.percentile("flux", 0.5).alias("level"))


@query(
    f"""SELECT exp, fiber, {s6('l / nullif(median(l) OVER (PARTITION BY exp), 0)')} AS offset FROM (SELECT exp, fiber, CASE WHEN count(c) OVER w >= 5 THEN regr_slope(c, fiber) OVER w * fiber + regr_intercept(c, fiber) OVER w ELSE 1 END AS l
    FROM {clip_sql(LEVELS, 'exp, amp', 'level', 3.0, 5)} WINDOW w AS (PARTITION BY exp, amp))"""
)
def agg_amp_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.amp_offsets(levels(spark, sf_dir), "exp", "amp", "fiber", "level", least=5).select("exp", "fiber", "offset"))


@query(
    f"""SELECT exp, idx, {s6('median(flux)')} AS sky FROM {SPEC} SEMI JOIN (SELECT exp, fiber FROM {clip_sql(f'(SELECT exp, fiber, median(flux) AS level FROM {SPEC} GROUP BY 1, 2)', 'exp', 'level', 3.0, 5)} WHERE c IS NOT NULL) k USING (exp, fiber) GROUP BY 1, 2"""
)
def agg_clipped_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.clipped_sky(spectra(spark, sf_dir), "exp", "fiber", "idx", "flux"))


def stat_sql(x: str) -> str:
    c = f"(SELECT l_suppkey, c FROM {clip_sql('lineitem', 'l_suppkey', x, 3.0, 5)})"
    return f"(SELECT l_suppkey, median(c) AS {x}_median, count(c) AS {x}_kept, any_value(s) AS {x}_std FROM {c} JOIN {mad_sql(c, ['l_suppkey'], 'c', 's')} USING (l_suppkey) GROUP BY 1)"


@query(f"SELECT l_suppkey, {s6('l_discount_median')} AS l_discount_median, {s6('l_discount_std')} AS l_discount_std, l_discount_kept, {s6('l_extendedprice_median')} AS l_extendedprice_median, {s6('l_extendedprice_std')} AS l_extendedprice_std, l_extendedprice_kept FROM {stat_sql('l_discount')} JOIN {stat_sql('l_extendedprice')} USING (l_suppkey)")
def agg_clip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.clip_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_discount", "l_extendedprice"))


AMPS = "(SELECT l_linenumber AS exp, l_suppkey AS amp, avg(l_quantity) AS x, avg(l_discount) AS y, avg(l_extendedprice) AS v, 500 * avg(l_tax + 1) AS sky FROM lineitem GROUP BY 1, 2)"
LEFT = f"""(SELECT amp, z - (b * x + c * y + avg(z) OVER w - b * avg(x) OVER w - c * avg(y) OVER w) AS rest FROM (SELECT *,
    (covar_pop(x, z) OVER w * var_pop(y) OVER w - covar_pop(y, z) OVER w * covar_pop(x, y) OVER w) / (var_pop(x) OVER w * var_pop(y) OVER w - pow(covar_pop(x, y) OVER w, 2)) AS b,
    (covar_pop(y, z) OVER w * var_pop(x) OVER w - covar_pop(x, z) OVER w * covar_pop(x, y) OVER w) / (var_pop(x) OVER w * var_pop(y) OVER w - pow(covar_pop(x, y) OVER w, 2)) AS c
    FROM (SELECT *, v / sky AS z FROM {AMPS}) WINDOW w AS (PARTITION BY exp)) WINDOW w AS (PARTITION BY exp))"""


@query(f"SELECT amp, {s6('1 - location')} AS factor FROM {biweight_sql(LEFT, ['amp'], 'rest')}")
def agg_amp_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("exp"), F.col("l_suppkey").alias("amp")).agg(
        F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"), F.avg("l_extendedprice").alias("v"), (500 * F.avg(F.col("l_tax") + 1)).alias("sky")
    )
    return rounded(amps.amp_colour(rows, "exp", "amp", "x", "y", "v", "sky"))


WAVED = f"(SELECT *, idx + fiber % 10 / 10.0 AS wave, ntile(50) OVER (PARTITION BY exp ORDER BY idx + fiber % 10 / 10.0, fiber, idx) AS bin FROM {SPEC})"


def waved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("wave", F.col("idx") + F.col("fiber") % 10 / 10)


@query(f"SELECT exp, bin, {s6('wave')} AS wave, {s6('lv')} AS flux FROM {biweight_sql(WAVED, ['exp', 'bin'], 'flux', loc='lv')} JOIN (SELECT exp, bin, avg(wave) AS wave FROM {WAVED} GROUP BY 1, 2) USING (exp, bin)")
def agg_count_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.count_template(waved(spark, sf_dir), ["exp"], "wave", ["fiber", "idx"], ["flux"], 50))


@query(
    f"""WITH k AS (SELECT exp, bin, wave, lv, lead(wave) OVER w AS wave2, lead(lv) OVER w AS lv2 FROM {biweight_sql(WAVED, ['exp', 'bin'], 'flux', loc='lv')} JOIN (SELECT exp, bin, avg(wave) AS wave FROM {WAVED} GROUP BY 1, 2) USING (exp, bin) WINDOW w AS (PARTITION BY exp ORDER BY wave))
    SELECT s.fiber, s.idx, {s6('CASE WHEN s.wave = k.wave THEN lv ELSE lv + (lv2 - lv) * (s.wave - k.wave) / (wave2 - k.wave) END')} AS template FROM {WAVED} s LEFT JOIN k ON k.exp = s.exp AND (s.wave >= k.wave AND s.wave < wave2 OR s.wave = k.wave)"""
)
def agg_template_at_wavelengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = waved(spark, sf_dir)
    knots = amps.count_template(s, ["exp"], "wave", ["fiber", "idx"], ["flux"], 50)
    return rounded(amps.at_wavelengths(s, knots, ["exp"], "wave", ["flux"]).select("fiber", "idx", F.col("__tflux").alias("template")))


@query()
def agg_fiber_to_fiber(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = waved(spark, sf_dir).withColumn("own", 1 + F.col("fiber") % 9 / 20)
    s = s.withColumns({"flat": F.col("own") * (5 + F.col("flux")), "science": F.col("own") * (8 - F.col("flux")), "twilight": F.col("own") * (9 + F.col("wave") / 10)})
    return rounded(amps.fiber_to_fiber(s, ["exp"], "fiber", "idx", "wave", "flat", "science", "twilight", 50, (5, 8)).select("fiber", "idx", "ftf"))


BRIGHT = f"(SELECT fiber, exp, idx, flux + 2 + idx / 32.0 AS flux FROM {SPEC})"
RATIO = f"(SELECT fiber, exp, idx, flux / avg_ AS q FROM {BRIGHT} JOIN {biweight_sql(BRIGHT, ['exp', 'idx'], 'flux', loc='avg_')} USING (exp, idx))"


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).withColumn("flux", F.col("flux") + 2 + F.col("idx") / 32)


RUNS = f"(SELECT *, ntile(8) OVER (PARTITION BY fiber ORDER BY idx) AS c FROM {RATIO})"


@query(
    f"""WITH k AS (SELECT fiber, c, avg(idx) AS a, any_value(lv) AS lv FROM {RUNS} JOIN {biweight_sql(RUNS, ['fiber', 'c'], 'q', loc='lv')} USING (fiber, c) GROUP BY 1, 2),
    s AS (SELECT *, lead(a) OVER w AS a2, lead(lv) OVER w AS lv2, row_number() OVER w = 1 AS one FROM k WINDOW w AS (PARTITION BY fiber ORDER BY a))
    SELECT fiber, idx, {s6('lv + coalesce((lv2 - lv) * greatest(0, (idx - a) / (a2 - a)), 0)')} AS norm FROM {SPEC} JOIN s USING (fiber) WHERE (one OR idx >= a) AND (a2 IS NULL OR idx < a2)"""
)
def agg_fiber_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.fiber_norm(bright(spark, sf_dir), ["exp"], "fiber", "idx", "flux", 8).select("fiber", "idx", "norm"))


@query(f"SELECT exp, fiber, c - 1 AS chunk, {s6('lv')} AS norm FROM {biweight_sql(RUNS, ['exp', 'fiber', 'c'], 'q', loc='lv')}")
def agg_chunk_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(amps.chunk_norm(bright(spark, sf_dir), ["exp"], "fiber", "idx", "flux", 8))


DIFF = f"(SELECT exp, fiber, flux - a AS rest FROM {SPEC} JOIN (SELECT exp, idx, avg(flux) AS a FROM {SPEC} GROUP BY 1, 2) USING (exp, idx))"


@query(
    f"""SELECT exp, fiber, max((coalesce(location > 0.003, false))::INT) OVER (PARTITION BY exp ORDER BY fiber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS flagged FROM {biweight_sql(DIFF, ['exp', 'fiber'], 'rest')}"""
)
def win_collapsed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    mean = s.groupBy("exp", "idx").agg(F.avg("flux").alias("a"))
    return amps.collapsed_flags(s.join(mean, ["exp", "idx"]), [], "exp", "fiber", "idx", "flux", "a", 0.003)


def continuum_sql(rounds: int) -> str:
    """Rounds of: smooth, carry over gaps, clip the residuals three times, leave outliers and their neighbours out."""
    by, kernel = "PARTITION BY fiber ORDER BY idx", [0.1, 0.2, 0.4, 0.2, 0.1]
    at = [f"lag(y, {2 - j}) OVER w" if j < 2 else f"lead(y, {j - 2}) OVER w" if j > 2 else "y" for j in range(5)]
    weight = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN {k} ELSE 0 END)" for x, k in zip(at, kernel))
    total = " + ".join(f"coalesce({x} * {k}, 0)" for x, k in zip(at, kernel))
    sql = f"(SELECT fiber, idx, flux, flux AS y FROM {SPEC})"
    for n in range(rounds):
        sql = f"(SELECT *, ({total}) / nullif({weight}, 0) AS v FROM {sql} WINDOW w AS ({by}))"
        sql = f"""(SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'i': idx, 'v': v}} END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
            first_value(CASE WHEN v IS NOT NULL THEN {{'i': idx, 'v': v}} END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {sql} WINDOW w AS ({by}))"""
        sql = f"(SELECT * EXCLUDE (v, a, b), coalesce(v, a.v + (b.v - a.v) * (idx - a.i) / nullif(b.i - a.i, 0), a.v, b.v) AS continuum FROM {sql})"
        sql = f"(SELECT *, flux - continuum AS r, flux - continuum AS c FROM {sql})"
        for _ in range(3):
            sql = f"(SELECT *, c - median(c) OVER (PARTITION BY fiber) AS d FROM {sql})"
            sql = f"(SELECT * EXCLUDE (d) REPLACE (CASE WHEN abs(d) <= 3.0 * 1.4826 * median(abs(d)) OVER (PARTITION BY fiber) THEN c END AS c) FROM {sql})"
        sql = f"(SELECT * EXCLUDE (r, c), c IS NULL AND r IS NOT NULL AS outlier FROM {sql})"
        if n < rounds - 1:
            sql = f"(SELECT fiber, idx, flux, CASE WHEN max(outlier::INT) OVER ({by} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 0 THEN flux END AS y FROM {sql})"
    return f"SELECT fiber, idx, {s6('continuum')} AS continuum, outlier FROM {sql}"


@query(continuum_sql(6))
def win_smooth_continuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = amps.smooth_continuum(spectra(spark, sf_dir), ["fiber"], "idx", "flux", [0.1, 0.2, 0.4, 0.2, 0.1])
    return rounded(out.select("fiber", "idx", "continuum", "outlier"))


@query(
    f"""WITH a AS (SELECT *, flux - median(flux) OVER (PARTITION BY fiber) AS d FROM {SPEC}), b AS (SELECT *, d / nullif(1.4826 * median(abs(d)) OVER (PARTITION BY fiber), 0) AS z FROM a),
    c AS (SELECT * EXCLUDE (d), z - median(z) OVER (PARTITION BY exp, idx) AS d FROM b), e AS (SELECT * EXCLUDE (z), least(greatest(d / nullif(1.4826 * median(abs(d)) OVER (PARTITION BY exp, idx), 0), -5), 5) AS z FROM c),
    f AS (SELECT *, coalesce(abs(z) > 2, true)::INT AS m FROM e), g AS (SELECT * EXCLUDE (m), CASE WHEN sum(m) OVER (PARTITION BY exp, fiber) > 6 THEN 1 ELSE m END AS m FROM f),
    h AS (SELECT * EXCLUDE (m), CASE WHEN sum(m) OVER (PARTITION BY exp, idx) > 12 THEN 1 ELSE m END AS m FROM g)
    SELECT fiber, idx, m = 1 OR coalesce(abs(sum(z) FILTER (m = 0) OVER w) > 1.5 * sqrt(count(*) FILTER (m = 0) OVER w), false) AS masked FROM h WINDOW w AS (PARTITION BY exp, idx)"""
)
def agg_spectral_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = amps.spectral_mask(spectra(spark, sf_dir), "exp", "fiber", "idx", "flux", 5.0, 2.0, 6, 12, 1.5)
    return out.select("fiber", "idx", "masked")


@query()
def agg_two_round_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir).withColumn("amp", F.col("fiber") % 2)
    sky = s.groupBy("exp", "idx").agg(F.percentile("flux", 0.5).alias("sky"))
    out = amps.two_round_sky(s.join(sky, ["exp", "idx"]), "exp", "amp", "fiber", "idx", "flux", "sky", 16, 48, 1.5, 2, least=4)
    return rounded(out.select("fiber", "idx", "skysub"))


@query(
    f"""WITH e AS (SELECT exp, idx, avg(flux) AS flux FROM {SPEC} GROUP BY 1, 2), m AS (SELECT idx, avg(flux) AS sky FROM e GROUP BY 1),
    a AS (SELECT *, sum(flux * sky) OVER w / sum(sky * sky) OVER w * sky AS base FROM e JOIN m USING (idx) WINDOW w AS (PARTITION BY exp))
    SELECT exp, idx, {s6('flux')} AS flux, {s6('base + model')} AS sky FROM {terms_sql('a', ['exp'], ['cos(idx / 10.0)', 'sin(idx / 10.0)'], 'flux - base')}"""
)
def fit_modelled_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    exposures = s.groupBy("exp", "idx").agg(F.avg("flux").alias("flux"))
    mean = exposures.groupBy("idx").agg(F.avg("flux").alias("sky"))
    basis = mean.select("idx", F.cos(F.col("idx") / 10).alias("b0"), F.sin(F.col("idx") / 10).alias("b1"))
    return rounded(amps.modelled_sky(exposures, mean, basis, "exp", "idx", "flux", 2))


MEANS = f"(SELECT fiber, idx, flux, idx / 32.0 - 1 AS x, avg(flux) OVER (PARTITION BY exp, idx) AS m FROM {SPEC})"


@query(f"SELECT fiber, idx, {s6('model')} AS model FROM {tukey_terms_sql(MEANS, ['fiber'], ['m', 'x * m', 'x * x * m', '1', 'x', 'x * x'], 'flux', 5)}")
def fit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux as a quadratic times the exposure's mean spectrum, plus a quadratic."""
    s = spectra(spark, sf_dir)
    mean = s.groupBy("exp", "idx").agg(F.avg("flux").alias("m"))
    rows = s.join(mean, ["exp", "idx"]).withColumn("x", F.col("idx") / 32 - 1)
    return rounded(amps.ratio_fit(rows, ["fiber"], "x", "m", "flux").select("fiber", "idx", "model"))


FIRST_FIT = poly_sql("lineitem", ["l_suppkey"], "l_quantity", "l_extendedprice", 4, "m1")
KEPT = f"(SELECT *, CASE WHEN kept THEN l_extendedprice END AS y FROM (SELECT *, abs(r) <= 3.0 * 1.4826 * median(abs(r)) OVER (PARTITION BY l_suppkey) AS kept FROM (SELECT *, l_extendedprice - m1 AS r FROM {FIRST_FIT})))"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, kept, round(model, 2) + 0.0 AS model FROM {poly_sql(KEPT, ['l_suppkey'], 'l_quantity', 'y', 4)}")
def fit_refit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = amps.refit_matches(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "kept", (F.round("model", 2) + F.lit(0.0)).alias("model"))
