"""Fits, images, catalogs, quality measures and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, fits, grid, qa
from ..sources import scans, sinks
from .join_queries import PLANE
from .registry import POS, SPEC, biweight_sql, mad_sql, positions, query, r6, rounded, s6, spectra, table
from .sql_tools import poly_sql, robust_sql


def clipped_line_sql(src: str, keys: str, x: str, y: str) -> str:
    over = f"OVER (PARTITION BY {keys})"
    return (
        f"SELECT {keys}, {s6('regr_slope(z, x)')} AS slope, {s6('regr_intercept(z, x)')} AS intercept, count(z) AS n FROM (SELECT {keys}, x, CASE WHEN abs(r) <= 3.0 * 1.4826 * median(abs(r)) {over} THEN y END AS z FROM ("
        f"SELECT *, y - (regr_slope(y, x) {over} * x + regr_intercept(y, x) {over}) AS r FROM (SELECT {keys}, {x} AS x, {y} AS y FROM {src}))) GROUP BY {keys}"
    )


@query(clipped_line_sql("lineitem", "l_suppkey", "l_quantity", "l_extendedprice"))
def fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.line_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(model, 2) + 0.0 AS model FROM {poly_sql('lineitem', ['l_suppkey'], 'l_quantity', 'l_extendedprice', 4)}")
def fit_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.poly_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 4)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("model", 2) + F.lit(0.0)).alias("model"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(model, 2) + 0.0 AS model FROM {robust_sql('lineitem', ['l_suppkey'], 'l_quantity', 'l_extendedprice', 2, 3, kind='tukey')}")
def fit_robust_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.robust_poly_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 2, kind="tukey", rounds=3)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("model", 2) + F.lit(0.0)).alias("model"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(model, 2) + 0.0 AS model FROM {robust_sql('lineitem', ['l_suppkey'], 'l_quantity', 'l_extendedprice', 2, 5)}")
def fit_huber_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.robust_poly_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice", 2)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("model", 2) + F.lit(0.0)).alias("model"))


def plane_sql(src: str) -> str:
    """z on x and y by l_suppkey: what x leaves of z on what it leaves of y."""
    w = "OVER (PARTITION BY l_suppkey)"
    left = f"(SELECT *, CASE WHEN z IS NOT NULL THEN y END AS yz, regr_slope(z, x) {w} AS bz, regr_intercept(z, x) {w} AS az FROM {src})"
    left = f"(SELECT *, y - regr_slope(yz, x) {w} * x - regr_intercept(yz, x) {w} AS yr, z - az - bz * x AS zr FROM {left})"
    return f"(SELECT * EXCLUDE (yz, bz, az, yr, zr), az + bz * x + yr * sum(zr * yr) {w} / sum(yr * yr) FILTER (z IS NOT NULL) {w} AS plane FROM {left})"


FLAT_PLANE = plane_sql("(SELECT *, l_quantity AS x, l_discount AS y, l_extendedprice AS z FROM lineitem)")
NEAR_PLANE = f"(SELECT * EXCLUDE (plane, d) REPLACE (CASE WHEN d <= 3.0 * 1.4826 * median(d) OVER (PARTITION BY l_suppkey) THEN z END AS z) FROM (SELECT *, abs(z - plane) AS d FROM {FLAT_PLANE}))"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(plane, 2) + 0.0 AS plane FROM {plane_sql(NEAR_PLANE)}")
def fit_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fits.plane_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("plane", 2) + F.lit(0.0)).alias("plane"))


@query(f"SELECT s.fiber, {s6('sum(t.flux * s.flux) / nullif(sum(t.flux * t.flux), 0)')} AS scale FROM {SPEC} s JOIN (SELECT idx, avg(flux) AS flux FROM {SPEC} GROUP BY 1) t USING (idx) GROUP BY 1")
def fit_template_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    t = s.groupBy("idx").agg(F.avg("flux").alias("t"))
    return rounded(fits.template_scale(s.join(t, "idx"), ["fiber"], "flux", "t"))


@query()
def fit_low_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spectrum without its projection on three principal components of all."""
    s = spectra(spark, sf_dir)
    basis, _ = fits.pca_basis(table(spark, sf_dir, "embeddings"), "embedding", 3)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(*basis))], "idx int, b0 double, b1 double, b2 double")
    out = fits.low_rank_projection(s, rows, ["fiber"], "idx", "flux", 3)
    return out.select("fiber", "idx", F.round(F.col("flux") - F.col("model"), 4).alias("residual"))


@query(
    f"""WITH c AS (SELECT a.exp, b.idx - a.idx AS lag, sum(a.flux * b.flux) AS c FROM (SELECT exp, idx, avg(flux) AS flux FROM {SPEC} GROUP BY 1, 2) a JOIN
    (SELECT exp - 1 AS exp, idx, avg(flux) AS flux FROM {SPEC} GROUP BY 1, 2) b ON a.exp = b.exp AND b.idx - a.idx BETWEEN -6 AND 6 GROUP BY 1, 2),
    d AS (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS n FROM c WINDOW w AS (PARTITION BY exp ORDER BY lag))
    SELECT exp, lag, {s6('lag + coalesce((p - n) / nullif(2 * (p - 2 * c + n), 0), 0)')} AS shift, {s6('c')} AS product FROM d QUALIFY row_number() OVER (PARTITION BY exp ORDER BY c DESC, lag) = 1"""
)
def fit_cross_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = spectra(spark, sf_dir).groupBy("exp", "idx").agg(F.avg("flux").alias("flux"))
    return rounded(fits.cross_correlate(mean, mean.withColumn("exp", F.col("exp") - 1), ["exp"], "idx", "flux", 6))


@query(
    f"""WITH p AS (SELECT vec_id % 5 AS k, (ra - 150) * 360 AS x, (dec - 2) * 360 AS y FROM {POS}),
    v AS (SELECT a.k, a.x, a.y, count(*) AS votes, avg(b.x) AS mx, avg(b.y) AS my FROM p a JOIN p b ON a.k = b.k AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25 GROUP BY ALL)
    SELECT k, {s6('mx')} AS dx, {s6('my')} AS dy, votes FROM v WHERE votes >= 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY votes DESC, x, y) = 1"""
)
def fit_offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).select((F.col("vec_id") % 5).alias("k"), ((F.col("ra") - 150) * 360).alias("x"), ((F.col("dec") - 2) * 360).alias("y"))
    return rounded(fits.offset_vote(p, ["k"], "x", "y", 1.5))


@query(
    f"""WITH p AS (SELECT p.label, px, py, px * cos(radians(0.2)) - py * sin(radians(0.2)) + 0.01 * CAST(e.embedding[3] AS DOUBLE) AS x,
        px * sin(radians(0.2)) + py * cos(radians(0.2)) + 0.01 * CAST(e.embedding[4] AS DOUBLE) AS y FROM (SELECT *, (SELECT any_value(label) FROM embeddings q WHERE q.vec_id = z.vec_id) AS label FROM {PLANE} z) p JOIN embeddings e USING (vec_id)),
    t AS (SELECT label, rotation, px * cos(radians(rotation)) - py * sin(radians(rotation)) - x AS dx, px * sin(radians(rotation)) + py * cos(radians(rotation)) - y AS dy
        FROM p, (SELECT -1.0 + 2.0 * i / 200 AS rotation FROM range(0, 201) r(i))),
    m AS (SELECT *, median(dx) OVER w AS mx, median(dy) OVER w AS my FROM t WINDOW w AS (PARTITION BY label, rotation)),
    s AS (SELECT label, rotation, any_value(mx) AS dx, any_value(my) AS dy, sqrt(median(abs(dx - mx)) * median(abs(dy - my))) * 1.4826 AS scatter FROM m GROUP BY 1, 2)
    SELECT label, {s6('rotation')} AS rotation, {s6('dx')} AS dx, {s6('dy')} AS dy, {s6('scatter')} AS scatter FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY scatter, abs(rotation), rotation) = 1"""
)
def fit_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sky import to_plane

    p = positions(spark, sf_dir)
    x, y = to_plane(F.col("ra"), F.col("dec"), F.lit(150.0), F.lit(2.0), rotation=0.2)
    pairs = p.select("label", "ra", "dec", (x + 0.01 * F.col("flux")[2]).alias("x"), (y + 0.01 * F.col("flux")[3]).alias("y"))
    return rounded(fits.rotation_search(pairs, ["label"], F.lit(150.0), F.lit(2.0)))


@query(
    f"""WITH s AS (SELECT fiber, idx / 16.0 AS r, exp(-idx / 16.0 * (1 + fiber % 7 / 5.0)) + flux / 50 AS f FROM {SPEC}), a AS (SELECT 1.0::DOUBLE + 0.1::DOUBLE * k AS fwhm, (1.0 + 0.1::DOUBLE * k) / (2 * sqrt(pow(2, 1 / 3.5) - 1)) AS alpha FROM range(0, 30) w(k)),
    t AS (SELECT fiber, fwhm, f, 2.5 / (pi() * alpha * alpha) * pow(1 + pow(round(r / 0.05) * 0.05 / alpha, 2), -3.5) AS v FROM s, a WHERE round(r / 0.05) < 200),
    c AS (SELECT fiber, fwhm, (sum(f * f) - pow(sum(f * v), 2) / sum(v * v)) / 0.01 AS chi2 FROM t GROUP BY 1, 2),
    d AS (SELECT *, lag(chi2) OVER w AS c0, lead(chi2) OVER w AS c2, lead(fwhm) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY fiber ORDER BY fwhm))
    SELECT fiber, round(fwhm, 4) AS fwhm, round(fwhm + coalesce((c0 - c2) / nullif(2 * (c0 - 2 * chi2 + c2), 0) * (p2 - fwhm), 0), 4) AS refined FROM d QUALIFY row_number() OVER (PARTITION BY fiber ORDER BY chi2, fwhm) = 1"""
)
def fit_seeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).withColumn("r", F.col("idx") / 16).withColumn("f", F.exp(-F.col("r") * (1 + F.col("fiber") % 7 / 5)) + F.col("flux") / 50).withColumn("e", F.lit(0.1))
    profiles = fits.moffat_table(spark.range(0, 200), [1.0 + 0.1 * k for k in range(30)], 3.5, 0.05)
    return fits.grid_fit(rows, profiles, ["fiber"], "r", "f", "e", "fwhm", 0.05).select("fiber", F.round("fwhm", 4).alias("fwhm"), F.round("refined", 4).alias("refined"))


PTS = f"(SELECT vec_id, label, (ra - 150) * 100 AS x, (dec - 2) * 100 AS y, 1 + vec_id % 10 AS v FROM {POS})"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select("vec_id", "label", ((F.col("ra") - 150) * 100).alias("x"), ((F.col("dec") - 2) * 100).alias("y"), (1.0 + F.col("vec_id") % 10).alias("v"))


@query(
    f"""WITH i AS (SELECT px, py, sum(w * v) AS t, sum(w) AS w FROM (SELECT *, exp(-0.5 * (pow(px - x, 2) + pow(py - y, 2)) / 2.25) / (2 * pi() * 2.25) AS w FROM (
    SELECT *, CAST(round(x) AS BIGINT) + a AS px, CAST(round(y) AS BIGINT) + b AS py FROM {PTS}, range(-4, 5) p(a), range(-4, 5) q(b))) GROUP BY 1, 2)
    SELECT px, py, {s6('t / w')} AS v, {s6('w')} AS weight FROM i WHERE w >= 0.1 * (SELECT max(w) FROM i)"""
)
def grd_splat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.splat(points(spark, sf_dir), [], "x", "y", "v", 1.5, 4, 0.1))


@query(
    f"""SELECT px, py, {s6('median(v) / 0.75')} AS v, count(*) AS coverage, {s6('sqrt(sum(e * e)) / count(e) / 0.75')} AS error FROM (
    SELECT label, CAST(round(x) AS BIGINT) AS px, CAST(round(y) AS BIGINT) AS py, arg_max(v, vec_id) AS v, arg_max(0.1 + v / 20, vec_id) AS e FROM {PTS} GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def grd_median_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("e", 0.1 + F.col("v") / 20)
    return rounded(grid.median_mosaic(p, [], "label", "vec_id", "x", "y", "v", 0.75, "e"))


IMG = f"(SELECT fiber % 25 AS px, fiber // 25 AS py, sum(flux) AS v FROM {SPEC} GROUP BY 1, 2)"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    return s.groupBy((F.col("fiber") % 25).alias("px"), F.floor(F.col("fiber") / 25).alias("py")).agg(F.sum("flux").alias("v"))


@query(
    f"""SELECT a.px, a.py, {s6('sum(b.v * exp(-0.5 * (pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / 1.44)) / sum(exp(-0.5 * (pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) / 1.44))')} AS smoothed
    FROM {IMG} a JOIN {IMG} b ON abs(a.px - b.px) <= 3 AND abs(a.py - b.py) <= 3 GROUP BY 1, 2"""
)
def grd_smooth_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.smooth_2d(image(spark, sf_dir), [], "v", 1.2, 3))


@query(
    f"""SELECT s_suppkey, {s6('sum(v)')} AS total, count(v) AS n_pixels FROM (SELECT s_suppkey, (s_suppkey % 25) + 0.3 AS x, (s_nationkey % 20) + 0.1 AS y FROM supplier) a JOIN {IMG} i
    ON pow(px - x, 2) + pow(py - y, 2) <= 6.25 GROUP BY 1"""
)
def grd_aperture_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25 + 0.3).alias("x"), (F.col("s_nationkey") % 20 + 0.1).alias("y"))
    return rounded(grid.aperture_sum(image(spark, sf_dir), ap, "s_suppkey", "v", 2.5))


@query(
    f"""SELECT a.px, a.py, {s6('any_value(a.v)')} AS v, {s6('sum(greatest(b.v, 0) * b.px) / nullif(sum(greatest(b.v, 0)), 0)')} AS x, {s6('sum(greatest(b.v, 0) * b.py) / nullif(sum(greatest(b.v, 0)), 0)')} AS y
    FROM {IMG} a JOIN {IMG} b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 WHERE a.v > 0.3 GROUP BY 1, 2 HAVING any_value(a.v) >= max(b.v)"""
)
def grd_find_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.find_sources(image(spark, sf_dir), [], "v", F.col("v") > 0.3))


@query(
    f"""SELECT px, py, {s6('sum(w * v) / sum(w)')} AS v, count(*) AS n FROM (SELECT *, exp(-0.5 * r2 / 1.0) AS w FROM (SELECT *, pow(px - x, 2) + pow(py - y, 2) AS r2 FROM (
    SELECT *, CAST(round(x) AS BIGINT) + a AS px, CAST(round(y) AS BIGINT) + b AS py FROM {PTS}, range(-2, 3) p(a), range(-2, 3) q(b))) WHERE r2 <= 4) GROUP BY 1, 2"""
)
def grd_weighted_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.weighted_image(points(spark, sf_dir), [], "x", "y", "v", 1.0, 2.0))


@query(
    f"""WITH m AS (SELECT 2 * ceil(max(greatest(abs(x), abs(y)))) + 1 AS size FROM {PTS}),
    n AS (SELECT n + 1 - n % 2 AS n FROM (SELECT CAST(floor(size / 4) AS BIGINT) AS n FROM m)), p AS (SELECT px, py, (px - n // 2) * 4.0 AS x, (py - n // 2) * 4.0 AS y FROM n, range(0, n) a(px), range(0, n) b(py))
    SELECT p.px, p.py, p.x, p.y, count(q.vec_id) AS n_points FROM p LEFT JOIN {PTS} q ON round(q.x / 4) * 4 = p.x AND round(q.y / 4) * 4 = p.y GROUP BY ALL"""
)
def grd_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The square image that holds all points, and how many fall in each of its pixels."""
    p = points(spark, sf_dir)
    size = 2 * p.agg(F.ceil(F.max(F.greatest(F.abs("x"), F.abs("y"))))).first()[0] + 1
    at = p.select((F.round(F.col("x") / 4) * 4).alias("x"), (F.round(F.col("y") / 4) * 4).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    return grid.grid_setup(spark, size, 4.0).join(at, ["x", "y"], "left").select("px", "py", "x", "y", F.coalesce("n", F.lit(0)).alias("n_points"))


@query(
    f"""WITH v AS (SELECT fiber % 25 AS x, fiber // 25 AS y, idx, flux, flux / (0.1 + abs(flux) / 10) AS sn FROM {SPEC} WHERE (fiber + idx) % 6 <> 0)
    SELECT x, y, count(sn) AS n, {s6('count(sn) / 64.0')} AS coverage, count(sn) / 64.0 >= 0.8 AS covered, {s6('median(flux)')} AS continuum, {s6('1.4826 * median(d)')} AS sn_mad,
    {s6('quantile_cont(sn, 0.16)')} AS sn_p16, {s6('quantile_cont(sn, 0.5)')} AS sn_p50, {s6('quantile_cont(sn, 0.84)')} AS sn_p84
    FROM (SELECT *, abs(sn - median(sn) OVER (PARTITION BY x, y)) AS d FROM v) GROUP BY 1, 2"""
)
def agg_cube_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spectra(spark, sf_dir).where("(fiber + idx) % 6 <> 0").withColumn("error", 0.1 + F.abs("flux") / 10)
    v = v.select((F.col("fiber") % 25).alias("x"), F.floor(F.col("fiber") / 25).alias("y"), F.col("idx").alias("wave_idx"), "flux", "error")
    return rounded(grid.cube_stats(v, "flux", "error"))


@query(
    f"""WITH g AS (SELECT l_suppkey, l_extendedprice / 10000 - l_discount * 10 AS dm FROM lineitem WHERE l_quantity > 5),
    d AS (SELECT l_suppkey, location AS delta FROM {biweight_sql('g', ['l_suppkey'], 'dm')}), m AS (SELECT l_suppkey, mad_std AS scatter FROM {mad_sql('g', ['l_suppkey'], 'dm')})
    SELECT l_suppkey, {s6('delta')} AS delta, {s6('scatter')} AS scatter, n, {s6('pow(10, -0.4 * delta)')} AS factor FROM d JOIN m USING (l_suppkey) JOIN (SELECT l_suppkey, count(*) AS n FROM g GROUP BY 1) USING (l_suppkey)"""
)
def agg_shot_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_discount") * 10).withColumn("ref", F.col("l_extendedprice") / 10000)
    return rounded(catalog.shot_normalisation(li, "l_suppkey", "m", "ref", "l_quantity"))


@query(f"SELECT fiber, {s6('sum(flux * (idx + 1)) / sum((0.1 + abs(flux) / 10) * (idx + 1))')} AS sn FROM {SPEC} GROUP BY 1")
def agg_response_sn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir)
    return rounded(s.groupBy("fiber").agg(catalog.response_sn(F.col("flux"), 0.1 + F.abs("flux") / 10, F.col("idx") + 1).alias("sn")))


SEP = "degrees(2 * asin(least(1, sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600"


@query(f"SELECT a.vec_id FROM {POS} a WHERE NOT EXISTS (SELECT 1 FROM {POS} b WHERE b.label = a.label AND b.vec_id < a.vec_id AND {SEP} <= 25)")
def win_duplicates_in_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicates_in_shot(positions(spark, sf_dir), "label", "vec_id", 25.0).select("vec_id")


@query()
def win_dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dedupe_sources(positions(spark, sf_dir).withColumn("sn", F.col("flux")[5]), "vec_id", "sn", 4.0).select("vec_id")


@query("SELECT c_custkey, printf('SRC%09d', row_number() OVER (ORDER BY c_nationkey, c_custkey)) AS name FROM customer")
def win_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.object_ids(table(spark, sf_dir, "customer"), "SRC", "c_nationkey", "c_custkey").select("c_custkey", "name")


@query(
    f"""SELECT a.vec_id AS fiber, f.idx, {s6('any_value(f.flux)')} AS flux FROM {POS} a JOIN {SPEC} f ON f.fiber = a.vec_id JOIN {POS} b ON {SEP} <= 12 JOIN {SPEC} g ON g.fiber = b.vec_id AND g.idx = f.idx
    GROUP BY 1, 2 HAVING count(g.flux) > 1 AND sum(g.flux) > 0 AND any_value(f.flux) >= 0.5 * sum(g.flux)"""
)
def win_cosmics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir).join(positions(spark, sf_dir).select(F.col("vec_id").alias("fiber"), "ra", "dec"), "fiber")
    return rounded(catalog.cosmics(s, "fiber", "idx", "flux", 12.0))


@query("SELECT count(*) AS n_sources, count(DISTINCT l_orderkey) AS n_shots, count(DISTINCT (l_suppkey, l_partkey)) AS n_fibers FROM lineitem")
def agg_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.totals(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_suppkey", "l_partkey"])


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000 AND s_nationkey > 3 AND s_suppkey >= 5")
def prj_shot_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.where(catalog.shot_cut(F.col("s_acctbal"), F.col("s_nationkey"), F.col("s_suppkey"), 5000, 3)).select("s_suppkey")


@query(
    f"""SELECT l_suppkey, {s6('avg(CASE WHEN l_tax > 0.05 THEN 1.0 ELSE 0.0 END)')} AS masked_share, count(*) FILTER (l_discount > 0.02) AS n_warn, count(*) FILTER (l_discount > 0.05) AS n_fail,
    {s6('median(l_discount)')} AS l_discount_median, {s6('1.4826 * median(d)')} AS l_discount_mad FROM (SELECT *, abs(l_discount - median(l_discount) OVER (PARTITION BY l_suppkey)) AS d FROM lineitem) GROUP BY 1"""
)
def qa_amp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.amp_metrics(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_discount"], F.col("l_tax") > 0.05, 0.02, 0.05))


#: The mean of exact decimals: means that lie on a limit don't hang on the order in which doubles are added.
QA = "(SELECT l_suppkey, median(l_quantity) AS q, CAST(sum(CAST(l_discount AS DECIMAL(28, 12))) AS DOUBLE) / count(l_discount) AS d FROM lineitem GROUP BY 1)"


@query(
    """SELECT l_suppkey, CASE WHEN q >= 26 THEN 'fail' WHEN q >= 25 THEN 'warn' ELSE 'pass' END AS q, CASE WHEN d >= 0.051 THEN 'fail' WHEN d >= 0.05 THEN 'warn' ELSE 'pass' END AS d,
    CASE WHEN q >= 26 OR d >= 0.051 THEN 'fail' WHEN q >= 25 OR d >= 0.05 THEN 'warn' ELSE 'pass' END AS overall FROM """
    + QA
)
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.try_divide(F.sum(F.col("l_discount").cast("decimal(28,12)")).cast("double"), F.count("l_discount"))
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.percentile("l_quantity", 0.5).alias("q"), mean.alias("d"))
    records = qa.qa_status(m, ["l_suppkey"], {"q": (25, 26), "d": (0.05, 0.051)})
    return qa.qa_report(qa.from_json(qa.to_json(records), records.schema.simpleString()), "l_suppkey", ["q", "d"])


BANDS = f"(SELECT exp, CASE WHEN idx < 20 THEN 'blue' WHEN idx >= 22 AND idx < 42 THEN 'central' WHEN idx >= 44 THEN 'red' END AS band, flux FROM {SPEC})"


@query(
    f"""SELECT exp, band, {s6('median(flux)')} AS median, {s6('stddev_pop(flux)')} AS std, {s6('1.4826 * median(d)')} AS mad FROM (
    SELECT *, abs(flux - median(flux) OVER (PARTITION BY exp, band)) AS d FROM {BANDS} WHERE band IS NOT NULL) GROUP BY 1, 2"""
)
def qa_band_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.band_residuals(spectra(spark, sf_dir), ["exp"], "idx", "flux", {"blue": (0, 20), "central": (22, 42), "red": (44, 64)}))


@query(f"WITH h AS (SELECT 1 + CAST(floor((flux * 10 + 6) / 0.06) AS BIGINT) AS bin FROM {SPEC} WHERE flux * 10 >= -6 AND flux * 10 < 6) SELECT bin, count(*) AS n, {s6('count(*) / (SELECT count(*) FROM h) / 0.06')} AS density FROM h GROUP BY 1")
def qa_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.histogram(spectra(spark, sf_dir), F.col("flux") * 10, -6, 6, 200))


@query(
    f"""WITH s AS (SELECT *, 0.1 + abs(flux) / 10 AS e FROM {SPEC}), m AS (SELECT median(flux / e) AS m FROM s), f AS (SELECT 1.4826 * median(abs(flux / e - m)) AS f FROM s, m)
    SELECT fiber, {s6('sum(e * f)')} AS rescaled FROM s, f GROUP BY 1"""
)
def qa_error_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir).withColumn("e", 0.1 + F.abs("flux") / 10)
    return rounded(qa.error_rescale(s, "flux", "e").groupBy("fiber").agg(F.sum("rescaled").alias("rescaled")))


@query(
    f"""SELECT bin, {s6('median(d)')} AS median, {s6('1.4826 * median(r)')} AS mad, count(*) AS n FROM (SELECT *, abs(d - median(d) OVER (PARTITION BY bin)) AS r FROM (
    SELECT 1 + CAST(floor(l_quantity / 6) AS BIGINT) AS bin, l_extendedprice AS d FROM lineitem WHERE l_quantity < 54)) GROUP BY 1"""
)
def qa_binned_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.binned_scatter(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 0.0, 54.0, 9))


@query(f"SELECT exp, {s6('median(s)')} AS structure FROM (SELECT exp, abs(flux - lag(flux) OVER (PARTITION BY fiber ORDER BY idx)) AS s FROM {SPEC}) GROUP BY 1")
def qa_dark_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.dark_structure(spectra(spark, sf_dir), ["exp"], "fiber", "idx", "flux"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-02-28' AND o_orderdate < DATE '1996-04-04' AND o_orderpriority = '2-HIGH'")
def src_obs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of frames of a kind, padded by three days; the bounds reach the scan."""
    span = scans.date_range(start="1996-03-02", days=30)
    return scans.scan_obs_log(table(spark, sf_dir, "orders"), "o_orderdate", span, F.col("o_orderpriority") == "2-HIGH", 3).select("o_orderkey")


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) AS batch FROM orders WHERE o_orderpriority = '1-URGENT'")
def src_program_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.program_batches(table(spark, sf_dir, "orders"), F.col("o_orderpriority") == "1-URGENT", 7, "o_orderdate", "o_orderkey").select("o_orderkey", "batch")


@query("SELECT o_custkey, o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def src_first_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return scans.first_header_per_obs(o, ["o_custkey"], {"o_orderstatus": "?", "priority": "none"}, "o_orderdate", "o_orderkey")


@query("SELECT nullif(c_custkey, 0) AS c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS c_nationkey FROM customer")
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_catalog(table(spark, sf_dir, "customer"), sentinel=0.0).select("c_custkey", "c_acctbal", "c_nationkey")


@query(
    """WITH c AS (SELECT date_trunc('month', ts) AS m, min(event_id) AS cal FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id, cal, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month FROM events LEFT JOIN c ON date_trunc('month', ts) = m WHERE event_type = 'error'"""
)
def src_month_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    cal = ev.where("event_type = 'signup'").groupBy(F.trunc("ts", "MM").alias("m")).agg(F.min("event_id").alias("cal"))
    return scans.month_calibration(ev.where("event_type = 'error'"), cal, "ts", "m").select("event_id", "cal", F.col("next_month").cast("string").alias("next_month"))


@query(
    """SELECT reason, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'unknown kind' WHEN value < 5 * length(event_type) THEN 'too low' WHEN value > 80 THEN 'too high' END AS reason FROM events) GROUP BY 1"""
)
def prj_frame_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_type").distinct().withColumn("low", 5.0 * F.length("event_type")).withColumn("high", F.lit(80.0))
    out = scans.frame_sanity(table(spark, sf_dir, "events"), limits, "event_type", "value")
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 500000)")
def snk_open_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("size"))
    return sinks.open_tasks(table(spark, sf_dir, "customer"), out, "c_custkey", "size", 500_000).select("c_custkey")


@query("SELECT s_suppkey, printf('%d_%d_%03d', s_nationkey, s_suppkey % 4, s_suppkey % 112 + 1) AS fiber_name FROM supplier")
def snk_fiber_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("amp", F.col("s_suppkey") % 4)
    return sinks.fiber_names(s, "s_nationkey", "amp", "s_suppkey").select("s_suppkey", "fiber_name")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.union(s).distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(o)


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Science frames: all frames without those of a calibration kind."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ev.join(ev.where("event_type in ('click', 'view')").select("event_id"), "event_id", "left_anti").select("event_id")


@query(f"SELECT DISTINCT label, {s6('max(dec) OVER w')} AS top, first_value(vec_id) OVER (PARTITION BY label ORDER BY dec DESC, vec_id) AS best FROM {POS} WINDOW w AS (PARTITION BY label)")
def srt_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    best = p.groupBy("label").agg(F.max(F.struct("dec", (-F.col("vec_id")).alias("v"))).alias("b"))
    return best.select("label", r6("b.dec").alias("top"), (-F.col("b.v")).alias("best"))
