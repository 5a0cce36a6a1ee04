"""Cuts, sinks and text scans, frame defects and masters, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import arrays, calibrate, catalog, frames, grid
from ..operators.lineage import shared_folder
from ..sources import scans, sinks
from .registry import SPEC, query, r6, rounded, s6, spectra, table
from .window_queries import ROWS


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 3 AND l_discount * 100 > 1")
def prj_spectrum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(catalog.spectrum_cut(F.col("l_quantity") - 3, F.col("l_discount") * 100, 1.0))
    return li.select("l_orderkey", "l_linenumber")


@query(
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 15 AND 40 AND abs(l_discount - l_tax) < 0.05 AND (CAST(l_linenumber AS INT) & 4) = 0"""
)
def prj_star_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = catalog.star_cut(F.col("l_quantity"), 15.0, 40.0, F.col("l_discount"), F.col("l_tax"), 0.05, F.col("l_linenumber"), 4)
    return table(spark, sf_dir, "lineitem").where(cut).select("l_orderkey", "l_linenumber")


@query(f"SELECT fiber, count(*) FILTER (coalesce(abs(f - 1) > 0.1, true)) AS masked FROM (SELECT fiber, CASE WHEN idx % 9 > 0 THEN 1 + flux END AS f FROM {SPEC}) GROUP BY 1")
def prj_pixel_flat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra(spark, sf_dir).withColumn("f", F.when(F.col("idx") % 9 > 0, 1 + F.col("flux")))
    return s.groupBy("fiber").agg(F.count(F.when(frames.pixel_flat_mask(F.col("f")), 1)).alias("masked"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_tax <> 0 THEN l_tax ELSE l_discount END AS ra, CASE WHEN l_quantity > 25 AND l_tax <> 0 THEN l_extendedprice ELSE l_quantity END AS dec FROM lineitem"""
)
def prj_alternate_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = frames.alternate_position(F.col("l_discount"), F.col("l_quantity"), F.nullif("l_tax", F.lit(0.0)), F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ra.alias("ra"), dec.alias("dec"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) >= 1e-8 THEN l_discount END AS flux FROM lineitem")
def prj_blank_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.blank_zero(F.col("l_discount")).alias("flux"))


@query("SELECT event_id, CASE WHEN value BETWEEN 10 AND 80 THEN value ELSE 42 END AS value FROM events")
def prj_guide_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalar.guide_default(F.col("value"), 10.0, 80.0, 42.0).alias("value"))


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return c.union(s)


@query("SELECT o_orderkey, o_custkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01'")
def snk_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in folders by month, and half a year of them scanned again."""
    folder = scratch(spark)
    sinks.write_by_date(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.trunc("o_orderdate", "MM").alias("date")), folder)
    return scans.scan_fibers(spark, folder, ["o_orderkey", "o_custkey", "date"], ("1996-01-01", "1996-07-01")).withColumn("date", F.col("date").cast("string"))


@query(
    """SELECT 'all' AS part, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier UNION ALL SELECT 'unique', count(*), round(sum(s_acctbal), 2) FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1)
    UNION ALL SELECT 'shots', count(*), CAST(sum(n_nationkey) AS DOUBLE) FROM nation"""
)
def snk_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, unique ones and the shots written as a combined catalog, and read again."""
    from ..operators.windows import first_per

    s, folder = table(spark, sf_dir, "supplier"), scratch(spark)
    unique = first_per(s, ["s_nationkey"], "s_suppkey")
    written = list(catalog.catalog_writer(s, unique, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("s_acctbal")), folder))
    parts = [spark.read.parquet(path).agg(F.lit(path.rpartition("/")[2]).alias("part"), F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total")) for path in written]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT fiber, exp, idx, {s6('flux')} AS flux FROM {SPEC}")
def snk_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute written by exposure and read again."""
    folder = scratch(spark)
    sinks.write_attribute(spectra(spark, sf_dir), folder, "fiber")
    return rounded(spark.read.parquet(folder).select("fiber", "exp", "idx", "flux"))


@query(f"SELECT v.*, n FROM (SELECT fiber, idx, {s6('flux')} AS flux FROM {SPEC}) v, (SELECT count(*) AS n FROM embeddings)")
def snk_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, s = scratch(spark), spectra(spark, sf_dir)
    sinks.write_cube(s.select("fiber", "idx", "flux"), table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n")), folder)
    return rounded(spark.read.parquet(f"{folder}/voxels").crossJoin(F.broadcast(spark.read.parquet(f"{folder}/grid"))))


@query("SELECT s_suppkey AS shot, CASE WHEN s_nationkey > 4 THEN s_nationkey END AS seeing FROM supplier")
def src_shot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of blank-separated lines, some with a field that is no number."""
    folder = scratch(spark)
    seeing = F.when(F.col("s_nationkey") > 4, F.col("s_nationkey").cast("string")).otherwise("none")
    table(spark, sf_dir, "supplier").select(F.concat_ws(" ", F.lit("x"), F.col("s_suppkey").cast("string"), F.lit(" "), seeing)).write.text(folder)
    return scans.scan_shot_log(spark, folder, {1: ("shot", "bigint"), 2: ("seeing", "int")})


@query("SELECT CAST(l_linenumber AS VARCHAR) AS amp, l_orderkey AS fiber, l_quantity AS position FROM lineitem")
def src_keyed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in text, one folder an amp, with a comment at their head."""
    folder = scratch(spark)
    li = table(spark, sf_dir, "lineitem")
    lines = li.select("l_linenumber", F.concat_ws("  ", F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string")).alias("value"))
    head = li.select("l_linenumber", F.lit("# fiber position").alias("value")).distinct()
    head.unionByName(lines).withColumnRenamed("l_linenumber", "amp").write.partitionBy("amp").text(folder)
    return scans.scan_keyed_text(spark, f"{folder}/*/*.txt", r"amp=(\d+)", ["amp"], {"fiber": "bigint", "position": "double"}).drop("__path")


@query("SELECT c_custkey AS id, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) AS value FROM customer WHERE c_custkey % 7 > 0")
def src_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records, a seventh of them broken off and left out, with a default."""
    folder = scratch(spark)
    c = table(spark, sf_dir, "customer")
    record = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value")))
    c.select(F.when(F.col("c_custkey") % 7 > 0, record).otherwise(F.lit('{"id": 1, "value'))).write.text(folder)
    return scans.scan_qa(spark, folder, "id bigint, value double", {"value": -1.0})


@query(
    f"""SELECT exp, idx, block, {s6('median(flux)')} AS master FROM {SPEC} JOIN (SELECT exp, fiber, sum(j) OVER (PARTITION BY exp ORDER BY fiber) AS block FROM (
    SELECT exp, fiber, coalesce((fiber - lag(fiber) OVER (PARTITION BY exp ORDER BY fiber) > 1)::INT, 0) AS j FROM (SELECT DISTINCT exp, fiber FROM {SPEC}))) USING (exp, fiber) GROUP BY 1, 2, 3"""
)
def agg_block_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibrate.block_masters(spectra(spark, sf_dir), ["exp"], "fiber", "idx", "flux")
    return rounded(out.select("exp", "idx", F.col("block").cast("long").alias("block"), "master"))


@query(
    f"""WITH a AS (SELECT exp, rw, idx, flux - median(flux) OVER (PARTITION BY exp, idx) AS y FROM {ROWS}), b AS (SELECT exp, rw, idx, y - median(y) OVER (PARTITION BY exp, rw) AS y FROM a),
    """
    + ", ".join(
        [
            f"c{n} AS (SELECT * EXCLUDE (m, s, c), CASE WHEN abs(c - m) <= 3 * s THEN c END AS c FROM (SELECT *, stddev_pop(c) OVER (PARTITION BY exp) AS s, median(c) OVER (PARTITION BY exp) AS m FROM {src}))"
            for n, src in enumerate(["(SELECT *, y AS c FROM b)", "c0", "c1", "c2", "c3"])
        ]
    )
    + """, h AS (SELECT *, coalesce(abs(y) > 2.2 * stddev_pop(c) OVER (PARTITION BY exp), false) AS hot, max(rw) OVER (PARTITION BY exp) AS last FROM c4),
    s AS (SELECT *, (y > 0.1 AND coalesce(lead(hot) OVER (PARTITION BY exp, idx ORDER BY rw), false) AND rw + 2 <= last)::INT AS streak FROM h)
    SELECT exp, idx, count(*) FILTER (hot OR any_streak = 1) AS hot FROM (SELECT *, max(streak) OVER (PARTITION BY exp, idx) AS any_streak FROM s) GROUP BY 1, 2"""
)
def agg_hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).withColumn("rw", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1)
    out = calibrate.hot_pixels(rows, ["exp"], "rw", "idx", "flux", n_sigma=2.2, bright=0.1)
    return out.groupBy("exp", "idx").agg(F.count(F.when(F.col("hot"), 1)).alias("hot"))


@query(
    f"""WITH r AS (SELECT exp, rw, idx, flux + 1 AS v, quantile_cont(flux + 1, 0.5) OVER (PARTITION BY exp, rw ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS run FROM {ROWS}),
    b AS (SELECT *, (abs((v - run) / run) > 0.1 AND run >= 0.95 AND idx BETWEEN 8 AND 55)::INT AS bad FROM r)
    SELECT exp, idx, count(*) FILTER (bad = 1 OR total > 18) AS defects FROM (SELECT *, sum(bad) OVER (PARTITION BY exp, idx) AS total FROM b) GROUP BY 1, 2"""
)
def agg_flat_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).withColumn("rw", F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1).withColumn("v", F.col("flux") + 1)
    out = calibrate.flat_defects(rows, ["exp"], "rw", "idx", "v", level=0.95, most=18)
    return out.groupBy("exp", "idx").agg(F.count(F.when(F.col("defect"), 1)).alias("defects"))


@query(
    f"""WITH f AS (SELECT exp, rw, idx, flux + 1 AS v, 0.05 + abs(flux) / 10 AS e, 1 + rw % 5 / 10.0 + idx % 3 / 10.0 AS g FROM {ROWS}), t AS (SELECT exp, rw AS fiber, idx, round((rw * (n - 5))::DOUBLE / n + 2 + (idx % 10)::DOUBLE / 20) AS at FROM f JOIN (SELECT exp, max(rw) + 1 AS n FROM f GROUP BY 1) USING (exp)),
    m AS (SELECT t.exp, t.fiber, t.idx, v, e, g, g * sum(v) OVER w / sum(g) OVER w AS model FROM t JOIN f ON f.exp = t.exp AND f.idx = t.idx AND f.rw BETWEEN t.at - 2 AND t.at + 2 WINDOW w AS (PARTITION BY t.exp, t.fiber, t.idx))
    SELECT exp, fiber, idx AS col, {s6('sum(pow(v - model, 2) / (e * e + pow(0.01 * model, 2))) / nullif(count(v) - 1, 0)')} AS chi2 FROM m GROUP BY 1, 2, 3"""
)
def arr_profile_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).withColumn("row", (F.row_number().over(Window.partitionBy("exp", "idx").orderBy("fiber")) - 1).cast("int"))
    frame = rows.select("exp", "row", F.col("idx").alias("col"), (F.col("flux") + 1).alias("v"), (0.05 + F.abs("flux") / 10).alias("e"))
    flat = rows.select("exp", "row", F.col("idx").alias("col"), (1 + F.col("row") % 5 / 10 + F.col("idx") % 3 / 10).alias("v"))
    n = F.max("row").over(Window.partitionBy("exp")) + 1
    trace = rows.select("exp", F.col("row").alias("fiber"), F.col("idx").alias("col"), (F.col("row") * (n - 5) / n + 2 + F.col("idx") % 10 / 20).alias("trace"))
    return rounded(arrays.profile_chi2(frame, flat, trace, ["exp"], "v", "e"))


@query(
    f"""SELECT fiber % 5 * 6 + idx % 8 - 1 AS px, fiber // 5 * 6 + idx // 8 - 1 AS py, {s6('flux')} AS v FROM {SPEC} WHERE idx % 8 BETWEEN 1 AND 6 AND idx // 8 BETWEEN 1 AND 6"""
)
def grd_mosaic_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 cells, whose inner 6 x 6 make one image."""
    s = spectra(spark, sf_dir)
    tiles = s.select((F.col("fiber") % 5).alias("tile_x"), F.floor(F.col("fiber") / 5).alias("tile_y"), (F.col("idx") % 8).alias("px"), F.floor(F.col("idx") / 8).alias("py"), r6("flux").alias("v"))
    return grid.mosaic_tiles(tiles, 6, 1)


def clip_both_sql(rounds: int) -> str:
    now = "(SELECT l_suppkey, l_extendedprice AS a, l_quantity AS b, true AS ok FROM lineitem)"
    for _ in range(rounds):
        for c in "ab":
            now = (
                f"(SELECT l_suppkey, a, b, ok AND abs({c} - m) <= 1.5 * s AS ok FROM (SELECT *, 1.4826 * median(CASE WHEN ok THEN abs({c} - m) END) OVER (PARTITION BY l_suppkey) AS s "
                f"FROM (SELECT *, median(CASE WHEN ok THEN {c} END) OVER (PARTITION BY l_suppkey) AS m FROM {now})))"
            )
    return now


@query(f"SELECT l_suppkey, {s6('median(a)')} AS offset, {s6('median(b)')} AS fwhm, count(*) AS n_stars FROM {clip_both_sql(3)} WHERE ok GROUP BY 1")
def agg_photometric_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.photometric_offset(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", rounds=3, n_sigma=1.5))
