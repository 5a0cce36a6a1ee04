"""Joins, keys, filters, sets and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, sky
from ..operators import joins
from .registry import POS, query, positions, r6, rounded, s6, table

SEP = "degrees(2 * asin(least(1, sqrt(pow(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(b.ra - a.ra) / 2), 2))))) * 3600"


def within_sql(which: str, radius: float) -> str:
    """Pairs within the radius by their separation as it is; only what is shown is rounded."""
    return f"SELECT vec_id_l, vec_id_r, {s6('sep')} AS sep FROM (SELECT a.vec_id AS vec_id_l, b.vec_id AS vec_id_r, {SEP} AS sep FROM {POS} a, {POS} b WHERE {which}) WHERE sep <= {radius}"


@query(within_sql("a.vec_id < b.vec_id", 20))
def jn_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).select("vec_id", "ra", "dec")
    return rounded(joins.within_radius(p, p, 20.0).where("vec_id_l < vec_id_r").select("vec_id_l", "vec_id_r", "sep"))


@query(within_sql("b.label < 5", 60))
def jn_cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).select("vec_id", "label", "ra", "dec")
    return rounded(joins.cone_search(p, p, 60.0, keep=F.col("label") < 5).select("vec_id_l", "vec_id_r", "sep"))


@query(
    f"""SELECT q.vec_id, match, {s6('sep')} AS sep FROM (SELECT vec_id FROM {POS} WHERE label % 2 = 0) q LEFT JOIN (SELECT * FROM (SELECT a.vec_id, b.vec_id AS match, {SEP} AS sep
    FROM {POS} a, {POS} b WHERE a.label % 2 = 0 AND b.label % 2 = 1) WHERE sep <= 45 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sep, match) = 1) m USING (vec_id)"""
)
def jn_nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return rounded(joins.nearest_match(p.where("label % 2 = 0"), p.where("label % 2 = 1"), "vec_id", "vec_id", 45.0).select("vec_id", "match", "sep"))


@query(f"SELECT a.vec_id, bool_or({SEP} <= 30) AS near FROM {POS} a, {POS} b WHERE b.label = 3 GROUP BY 1")
def jn_flag_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    return joins.flag_near(p.select("vec_id", "ra", "dec"), p.where("label = 3"), 30.0, "vec_id").select("vec_id", "near")


@query(within_sql("a.label < b.label", 15))
def jn_repeat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir).select("vec_id", "label", "ra", "dec")
    return rounded(joins.repeat_pairs(p, 15.0, "label").select("vec_id_l", "vec_id_r", "sep"))


@query(
    """WITH s AS (SELECT DISTINCT p_size AS slot, p_size // 10 AS x, p_size % 10 AS y FROM part) SELECT a.slot, b.slot AS neighbor FROM s a, s b
    WHERE abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.slot <> b.slot"""
)
def jn_slot_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_size").alias("slot")).distinct()
    return joins.slot_neighbors(s.select("slot", scalar.slot_x(F.col("slot")).alias("x"), scalar.slot_y(F.col("slot")).alias("y")), 2)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, tx AS tile_x, ty AS tile_y FROM lineitem, range(-1, 12) a(tx), range(-1, 12) b(ty)
    WHERE l_quantity BETWEEN tx * 6 - 3.5 AND tx * 6 + 3.5 AND l_discount * 100 BETWEEN ty * 6 - 3.5 AND ty * 6 + 3.5"""
)
def jn_box_cutout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity")).withColumn("y", F.col("l_discount") * 100)
    return joins.box_cutout(f, 3.0, 0.5, 6.0).select("l_orderkey", "l_linenumber", "l_partkey", "tile_x", "tile_y")


@query(
    """SELECT fiber, tx AS tile_x, ty AS tile_y FROM (SELECT vec_id AS fiber, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings WHERE len(list_filter(embedding, lambda v: v > -0.15)) > 58),
    range(-40, 41) a(tx), range(-40, 41) b(ty) WHERE x BETWEEN tx * 6 - 3.5 AND tx * 6 + 3.5 AND y BETWEEN ty * 6 - 3.5 AND ty * 6 + 3.5"""
)
def jn_box_cutout_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the fibers that have enough valid bins."""
    e = table(spark, sf_dir, "embeddings")
    flux = F.transform("embedding", lambda v: F.when(v > -0.15, v))
    f = e.select(F.col("vec_id").alias("fiber"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"), flux.alias("flux"))
    return joins.box_cutout(f, 3.0, 0.5, 6.0, spectrum="flux", least=58).select("fiber", "tile_x", "tile_y")


ASOF = "SELECT user_id, ts, min(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY 1, 2"


@query(
    f"""WITH r AS ({ASOF}) SELECT e.event_id, CASE WHEN date_diff('microsecond', r.ts, e.ts) <= 5 * 86400000000 THEN r.id END AS match
    FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts"""
)
def jn_asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return joins.asof(left, right, ["user_id"], "ts", "event_id", "event_id", tolerance=5 * 86_400).select("event_id", "match")


@query(
    f"""WITH r AS ({ASOF}), e AS (SELECT * FROM events WHERE event_type = 'purchase') SELECT event_id, (SELECT id FROM r WHERE r.user_id = e.user_id
    ORDER BY abs(date_diff('microsecond', r.ts, e.ts)), r.ts LIMIT 1) AS match FROM e"""
)
def jn_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return joins.asof(left, right, ["user_id"], "ts", "event_id", "event_id", mode="nearest").select("event_id", "match")


@query(
    """SELECT p.event_id AS point, s.event_id AS span FROM (SELECT * FROM events WHERE event_type = 'view') p JOIN (SELECT * FROM events WHERE event_type = 'error') s
    ON p.ts BETWEEN s.ts - INTERVAL 10 SECOND AND s.ts + INTERVAL 310 SECOND"""
)
def jn_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    spans = ev.where("event_type = 'error'").select("event_id", F.col("ts").alias("t0"), F.expr("ts + interval 300 seconds").alias("t1"))
    return joins.during(ev.where("event_type = 'view'"), spans, "ts", "t0", "t1").select(F.col("event_id_l").alias("point"), F.col("event_id_r").alias("span"))


@query(
    f"""WITH p AS (SELECT DISTINCT l_suppkey, l_extendedprice AS peak FROM lineitem), l AS (SELECT 2000.0 + 3000 * i AS line FROM range(0, 25) r(i)),
    m AS (SELECT l_suppkey, line, peak, abs(line - peak) AS gap FROM p JOIN l ON abs(line - peak) <= 400 QUALIFY row_number() OVER (PARTITION BY l_suppkey, line ORDER BY abs(line - peak), peak) = 1)
    SELECT l_suppkey, {s6('line')} AS line, {s6('peak')} AS peak, {s6('gap')} AS gap FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey, peak ORDER BY line) = 1"""
)
def jn_match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice").distinct()
    lines = spark.range(25).select((2000.0 + 3000 * F.col("id")).alias("line"))
    return rounded(joins.match_lines(peaks, lines, ["l_suppkey"], "l_extendedprice", "line", 400.0))


@query(
    """SELECT o_orderkey, CASE WHEN NOT (o_orderpriority = '1-URGENT' AND (o_orderdate >= '1993-01-01' AND o_orderdate < '1994-01-01' OR o_orderdate >= '1993-06-01' AND o_orderdate < '1995-03-01'))
    AND NOT (o_orderpriority = '5-LOW' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01') THEN o_totalprice END AS o_totalprice FROM orders"""
)
def jn_interval_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("1-URGENT", "1993-01-01", "1994-01-01"), ("1-URGENT", "1993-06-01", "1995-03-01"), ("5-LOW", "1996-01-01", "1997-01-01")]
    spans = spark.createDataFrame(rows, "o_orderpriority string, a string, b string").select("o_orderpriority", F.col("a").cast("timestamp_ntz").alias("date_from"), F.col("b").cast("timestamp_ntz").alias("date_to"))
    return joins.interval_mask(table(spark, sf_dir, "orders"), spans, ["o_orderpriority"], "o_orderdate", "o_totalprice").select("o_orderkey", "o_totalprice")


@query(
    """SELECT DISTINCT label, r AS "row", c AS col FROM (SELECT label, i - 1 AS c, CAST(round(vec_id % 20 + abs(CAST(embedding[i] AS DOUBLE))) AS INT) + o AS r FROM embeddings, range(1, 65) a(i), range(-3, 4) b(o)
    WHERE CAST(embedding[i] AS DOUBLE) > 0.25) WHERE r >= 0 AND r < 20"""
)
def jn_project_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("fiber"), F.posexplode("embedding").alias("col", "v"))
    trace = e.select("label", "fiber", "col", (F.col("fiber") % 20 + F.abs(F.col("v").cast("double"))).alias("trace"))
    return joins.project_mask(e.where(F.col("v").cast("double") > 0.25), trace, ["label"], "fiber", "col", 3, 20)


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def jn_present_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c.c_nationkey == s.s_nationkey, "left_semi").select("c_custkey")


@query(f"SELECT l_suppkey, {s6('sum(l_extendedprice * (1 + s_acctbal / 10000))')} AS scaled FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def jn_frames_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return rounded(li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 + F.col("s_acctbal") / 10000)).alias("scaled")))


@query("SELECT s_suppkey, printf('%03d_%03d_%03d_LL', s_suppkey, s_nationkey, s_suppkey % 7) AS key, s_nationkey AS slot, 'LL' AS amp FROM supplier")
def prj_amp_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = s.select("s_suppkey", scalar.amp_key(F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_suppkey") % 7, F.lit("LL")).alias("key"))
    parts = scalar.split_key(F.col("key"))
    return k.select("s_suppkey", "key", parts[1].alias("slot"), parts[3].alias("amp"))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {s6('CASE WHEN abs(l_discount) > 1e-8 THEN l_extendedprice / l_discount ELSE 0 END')} AS ratio,
    {s6('CASE WHEN l_quantity - 10 < 0 THEN 1 ELSE (l_quantity - 10) / 360 END')} AS dark, {s6('CASE WHEN l_tax = 0 THEN 1 ELSE 360 / l_tax END')} AS flux, (l_partkey // 112) % 3 AS exp FROM lineitem"""
)
def prj_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", scalar.safe_divide(c("l_extendedprice"), c("l_discount")).alias("ratio"), scalar.dark_scale(c("l_quantity") - 10).alias("dark"),
            scalar.flux_scale(c("l_tax")).alias("flux"), scalar.exposure_of(c("l_partkey"), 3).alias("exp"),
        )
    )


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {s6('1e15 * l_extendedprice * (1 + l_discount) * (1e-29 * 2.99792458e18) / pow(3500 + 40 * l_quantity, 2)')} AS density FROM lineitem")
def mth_flux_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    density = 1e15 * scalar.flux_density(c("l_extendedprice"), 1 + c("l_discount"), 3500 + 40 * c("l_quantity"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", density.alias("density")))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {s6('CASE WHEN l_extendedprice - 30000 > 0 THEN -2.5 * log10(l_extendedprice - 30000) + 23.9 ELSE 99 END')} AS mag,
    {s6('pow(10, -0.4 * (l_quantity - 23.9))')} AS flux, {s6('1.8 * pow((3500 + l_quantity * 40) / 4500, -0.2)')} AS seeing, {s6('0.05 / (1 + 2 * pow(l_quantity / 3, 1.5))')} AS scatter FROM lineitem"""
)
def mth_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return rounded(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", scalar.magnitude(c("l_extendedprice") - 30_000).alias("mag"), scalar.flux_of(c("l_quantity")).alias("flux"),
            scalar.seeing_at(F.lit(1.8), 3500 + c("l_quantity") * 40).alias("seeing"), scalar.scatter_profile(c("l_quantity"), 3.0, 0.05, 1.0, 2.0, 1.5).alias("scatter"),
        )
    )


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {s6('''CASE WHEN d <= abs(b - s) THEN pi() * least(b, s) * least(b, s) WHEN d >= b + s THEN 0
    ELSE s * s * acos(least(1, greatest(-1, (d * d + s * s - b * b) / (2 * d * s)))) + b * b * acos(least(1, greatest(-1, (d * d + b * b - s * s) / (2 * d * b)))) - 0.5 * sqrt(greatest(0, (s + b - d) * (d + s - b) * (d - s + b) * (d + s + b))) END''')} AS area
    FROM (SELECT *, l_quantity / 10 AS d, 2.0 AS b, 0.5 + l_tax * 10 AS s FROM lineitem)"""
)
def mth_overlap_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.overlap_area(c("l_quantity") / 10, F.lit(2.0), 0.5 + c("l_tax") * 10).alias("area")))


@query(
    f"""SELECT event_id, {s6('epoch_us(ts) / 86400e6 + 40587')} AS mjd, {s6('epoch_us(ts) / 86400e6 + 40587 + value / 2 / 86400')} AS mid, {s6('2000 + (epoch_us(ts) / 86400e6 + 40587 - 51544.5) / 365.25')} AS year,
    strftime(ts - INTERVAL 1 DAY, '%Y%m%d') AS day_before FROM events"""
)
def dat_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return rounded(
        table(spark, sf_dir, "events").select(
            "event_id", scalar.mjd(ts).alias("mjd"), scalar.midpoint_mjd(ts, F.col("value")).alias("mid"), scalar.decimal_year(ts).alias("year"), F.date_format(F.date_sub(F.to_date(ts), 1), "yyyyMMdd").alias("day_before")
        )
    )


@query(
    """SELECT p_partkey, unnest(CASE WHEN len(k) > 0 THEN k ELSE ['sci'] END) AS kind FROM (SELECT p_partkey, list_filter([CASE WHEN contains(n, 'steel') THEN 'bias' END, CASE WHEN contains(n, 'promo') THEN 'arc' END,
    CASE WHEN contains(n, 'polished') THEN 'flat' END], lambda x: x IS NOT NULL) AS k FROM (SELECT p_partkey, lower(replace(p_type || ' ' || p_name, ' ', '')) AS n FROM part))"""
)
def prj_frame_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = scalar.frame_kinds(F.concat_ws(" ", "p_type", "p_name"), {"bias": "steel", "arc": "promo", "flat": "polished"})
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(kinds).alias("kind"))


PLANE = f"""(SELECT vec_id, ra, dec, degrees(cos(d) * sin(r) / z) * 3600 AS px, degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(r)) / z) * 3600 AS py FROM (
    SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(r) AS z FROM (SELECT *, radians(ra - 150) AS r, radians(dec) AS d, radians(2.0) AS d0 FROM {POS})))"""


@query(
    f"""SELECT vec_id, {s6('(px * cos(radians(30)) - py * sin(radians(30))) / 0.5')} AS x, {s6('(px * sin(radians(30)) + py * cos(radians(30))) / 0.5')} AS y, {s6('ra')} AS ra, {s6('dec')} AS dec FROM {PLANE}"""
)
def geo_tangent_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected with a rotation and a scale, and back again: ra and dec are the round trip's."""
    at = F.lit(150.0), F.lit(2.0)
    x, y = sky.to_plane(F.col("ra"), F.col("dec"), *at, rotation=30.0, scale=0.5)
    ra, dec = sky.to_sky(F.col("x"), F.col("y"), *at, rotation=30.0, scale=0.5)
    return rounded(positions(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y")).select("vec_id", "x", "y", ra.alias("ra"), dec.alias("dec")))


@query(f"SELECT vec_id, {s6('(ra - 150) * cos(radians(2)) * 3600')} AS dra, {s6('(dec - 2) * 3600')} AS ddec, {s6('ra + (vec_id % 100) * 10 / 3.6e6 / cos(radians(dec))')} AS ra, {s6('dec')} AS dec FROM {POS}")
def geo_offsets_and_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positions(spark, sf_dir)
    dra, ddec = sky.offsets(F.lit(150.0), F.lit(2.0), F.col("ra"), F.col("dec"))
    ra, dec = sky.moved(F.col("ra"), F.col("dec"), (F.col("vec_id") % 100).cast("double"), F.lit(None).cast("double"), F.lit(10.0))
    return p.select("vec_id", r6(dra).alias("dra"), r6(ddec).alias("ddec"), r6(ra).alias("ra"), r6(dec).alias("dec"))
