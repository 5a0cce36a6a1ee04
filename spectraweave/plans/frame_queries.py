"""Frame corrections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from ..operators.arrays import to_array
from .registry import SPEC, biweight_sql, query, rounded, s6, spectra, table

OVER = f"(SELECT exp, fiber, flux FROM {SPEC} WHERE idx >= 56)"


@query(
    f"""SELECT s.fiber, s.idx, {s6('(flux - lv) * g')} AS flux, {s6('sqrt(rn * rn + greatest((flux - lv) * g, 0))')} AS error FROM (SELECT *, CASE WHEN fiber % 5 > 0 THEN fiber % 5 / 2.0 ELSE 0.85 END AS g,
    CASE WHEN fiber % 3 > 0 THEN fiber % 3 + 0.5 ELSE 3 END AS rn FROM {SPEC}) s JOIN {biweight_sql(OVER, ['exp'], 'flux', loc='lv')} USING (exp) WHERE idx < 56"""
)
def prj_base_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("exp"), F.col("vec_id").alias("fiber"), F.col("embedding").cast("array<double>").alias("flux"),
        F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 5 / 2.0).otherwise(-1.0).alias("gain"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3 + 0.5).otherwise(0.0).alias("rn"),
    )
    out = frames.base_reduce(e, ["exp"], "fiber", "flux", 8, "gain", "rn")
    long = out.select("fiber", F.posexplode(F.arrays_zip("flux", "error")).alias("idx", "v")).select("fiber", "idx", "v.flux", "v.error")
    return rounded(long)


@query(
    f"""SELECT s.fiber, s.idx, {s6('s.flux - m.flux * 0.5')} AS flux FROM {SPEC} s JOIN (SELECT exp, idx, median(flux) AS flux FROM {SPEC} GROUP BY 1, 2) m USING (exp, idx)"""
)
def prj_subtract_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    master = to_array(s.groupBy("exp", "idx").agg(F.percentile("flux", 0.5).alias("m")), ["exp"], ["m"], i="idx")
    lines = table(spark, sf_dir, "embeddings").select(F.col("label").alias("exp"), F.col("vec_id").alias("fiber"), F.col("embedding").cast("array<double>").alias("flux"))
    out = frames.subtract_master(lines, master, ["exp"], "flux", "m", F.lit(0.5))
    return rounded(out.select("fiber", F.posexplode("flux").alias("idx", "flux")))


@query(f"SELECT fiber, CAST(list(flux ORDER BY CASE WHEN exp % 2 = 1 THEN -idx ELSE idx END) AS DOUBLE[]) AS flux FROM (SELECT fiber, exp, idx, {s6('flux')} AS flux FROM {SPEC}) GROUP BY 1")
def prj_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 6) + F.lit(0.0))
    return e.select(F.col("vec_id").alias("fiber"), frames.flipped(v, F.col("label") % 2 == 1).alias("flux"))


@query(f"SELECT fiber, {s6('sum(CASE WHEN abs(idx - 30) <= 2 THEN flux END)')} AS line, {s6('median(CASE WHEN abs(idx - 30) > 2 AND abs(idx - 30) <= 8 THEN flux END)')} AS side FROM {SPEC} GROUP BY 1")
def prj_line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frames.line_window(F.col("idx"), 30, 2, 6)
    return rounded(spectra(spark, sf_dir).withColumn("w", w).groupBy("fiber").agg(F.sum(F.when(F.col("w") == "line", F.col("flux"))).alias("line"), F.percentile(F.when(F.col("w") == "side", F.col("flux")), 0.5).alias("side")))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {s6('l_quantity + CASE WHEN l_suppkey % 2 = 0 THEN CASE l_linenumber WHEN 1 THEN 0.0 WHEN 2 THEN 1.27 WHEN 3 THEN 1.27 ELSE 0.0 END ELSE 0.0 END')} AS x,
    {s6('l_discount + CASE WHEN l_suppkey % 2 = 0 THEN CASE l_linenumber WHEN 3 THEN -1.46 WHEN 2 THEN 0.73 ELSE 0.0 END ELSE 0.0 END')} AS y FROM lineitem"""
)
def prj_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.when(F.col("l_suppkey") % 2 == 0, 3).otherwise(2).alias("n"))
    return rounded(frames.with_dither(li, {1: (0.0, 0.0), 2: (1.27, 0.73), 3: (1.27, -1.46)}, "l_linenumber", "x", "y", "n").drop("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AND s_acctbal <= 6000")
def prj_without_bad_amps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return frames.without_bad_amps(table(spark, sf_dir, "supplier"), bad, ["s_nationkey"], "s_acctbal", 6000).select("s_suppkey")


BYSUPP = biweight_sql("lineitem", ["l_suppkey"], "l_extendedprice")


@query(
    f"""WITH b AS (SELECT * FROM {BYSUPP}), c AS (SELECT 1 AS one, location AS v FROM b), w AS (SELECT location AS l0, scale AS s0 FROM {biweight_sql('c', ['one'], 'v')})
    SELECT l_suppkey, {s6('location')} AS location, {s6('scale')} AS scale, abs(location - l0) > 2 * s0 AS flagged FROM b, w"""
)
def agg_residual_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.residual_throughput(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice"))


@query(
    f"""WITH r AS (SELECT s_nat, l_suppkey, l_extendedprice / nullif(lv, 0) AS rel FROM (SELECT *, l_suppkey % 10 AS s_nat FROM lineitem) JOIN
    {biweight_sql('(SELECT l_suppkey % 10 AS s_nat, l_linenumber, l_extendedprice FROM lineitem)', ['s_nat', 'l_linenumber'], 'l_extendedprice', loc='lv')} USING (s_nat, l_linenumber))
    SELECT s_nat, l_suppkey, n, CASE WHEN n >= 600 THEN {s6('location')} END AS correction FROM {biweight_sql('r', ['s_nat', 'l_suppkey'], 'rel')} JOIN (SELECT s_nat, l_suppkey, count(rel) AS n FROM r GROUP BY 1, 2) USING (s_nat, l_suppkey)"""
)
def agg_fiber_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("s_nat", F.col("l_suppkey") % 10)
    return rounded(frames.fiber_correction(li, "s_nat", "l_linenumber", "l_suppkey", "l_extendedprice", 600))


@query(
    f"""SELECT l_suppkey, l_linenumber, {s6('median(l_quantity) - any_value(x)')} AS dx, {s6('median(l_discount) - any_value(y)')} AS dy FROM lineitem JOIN
    (SELECT l_suppkey, median(l_quantity) AS x, median(l_discount) AS y FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2"""
)
def agg_position_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.position_drift(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity", "l_discount"))


MIDDLE = f"(SELECT exp, fiber FROM (SELECT exp, fiber, ntile(3) OVER (PARTITION BY exp ORDER BY lv, fiber) AS t FROM (SELECT exp, fiber, median(flux) AS lv FROM {SPEC} GROUP BY 1, 2)) WHERE t = 2)"
CLIPPED = f"""(SELECT exp, idx, CASE WHEN abs(flux - m) <= 3 * 1.4826 * median(abs(flux - m)) OVER (PARTITION BY exp, idx) THEN flux END AS c FROM (
    SELECT *, median(flux) OVER (PARTITION BY exp, idx) AS m FROM {SPEC} SEMI JOIN {MIDDLE} USING (exp, fiber)))"""


@query(f"SELECT exp, idx, {s6('sky')} AS sky FROM {biweight_sql(CLIPPED, ['exp', 'idx'], 'c', loc='sky')}")
def agg_single_pass_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.single_pass_sky(spectra(spark, sf_dir), "exp", "fiber", "idx", "flux"))


BELOW = """(SELECT l_linenumber, i, l_extendedprice FROM lineitem JOIN (SELECT l_linenumber, i, p5 + (p60 - p5) * i / 26 AS top FROM (SELECT l_linenumber, quantile_cont(l_extendedprice, 0.05) AS p5,
    quantile_cont(l_extendedprice, 0.6) AS p60 FROM lineitem GROUP BY 1), range(1, 27) r(i)) g USING (l_linenumber) WHERE l_extendedprice <= top)"""


@query(
    f"""SELECT l_linenumber, {s6('location')} AS background, {s6('scale')} AS noise FROM {biweight_sql(BELOW, ['l_linenumber', 'i'], 'l_extendedprice')}
    QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY scale / abs(location), i) = 1"""
)
def agg_image_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.image_background(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_extendedprice"))


@query(f"SELECT l_suppkey, {s6('quantile_cont(c, 0.05)')} AS p5, {s6('quantile_cont(c, 0.5)')} AS p50, {s6('quantile_cont(c, 0.95)')} AS p95 FROM (SELECT l_suppkey, (l_quantity - 20 * l_tax) / (l_quantity + 20 * l_tax) AS c FROM lineitem) GROUP BY 1")
def agg_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("v", 10 * F.col("l_tax"))
    return rounded(frames.contrast(li, ["l_suppkey"], "l_quantity", "v"))


@query(
    f"""WITH v AS (SELECT l_suppkey % 5 AS amp, l_linenumber AS exp, l_orderkey % 9 AS chunk, l_extendedprice AS x FROM lineitem)
    SELECT amp, exp, chunk, {s6('a.own / nullif(b.whole, 0)')} AS level FROM {biweight_sql('v', ['amp', 'exp', 'chunk'], 'x', loc='own')} a JOIN {biweight_sql('v', ['exp', 'chunk'], 'x', loc='whole')} b USING (exp, chunk)"""
)
def agg_amp_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("amp"), F.col("l_linenumber").alias("exp"), (F.col("l_orderkey") % 9).alias("chunk"), F.col("l_extendedprice").alias("x"))
    return rounded(frames.amp_levels(v, "amp", "exp", "chunk", "x"))


@query()
def agg_photometric_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("dm", F.col("l_extendedprice") / 10_000)
    return rounded(frames.photometric_offset(li, ["l_suppkey"], "dm", "l_quantity"))
