"""Arc identification and wavelength maps over the driver's tables: made arc spectra of the fibers of an exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import wavelengths, windows
from ..operators.lineage import dealt
from .sql_tools import apart_sql, poly_sql
from .registry import SPEC, query, rounded, s6, spectra
from .trace_queries import ORDERED

#: Lines of the lamps, in Angstrom (fixed values).
LINES = (3610.508, 3650.153, 4046.565, 4358.335, 4678.149, 4799.912, 4916.068, 5085.822, 5460.750)
COLUMNS = 256
LIMITS = {"brightest": 6, "separation": 2.5, "most": 15, "tolerance": 3.0}


def at_column(line: str | float, fiber: str) -> str:
    """The column at which a line stands in a fiber: a quadratic, shifted from fiber to fiber."""
    return f"(8 + 232 * ({line} - 3500) / 2000 + 6 * pow(({line} - 3500) / 2000, 2) + {fiber} / 40 + exp / 20)"


def light(n: int, line: float, fiber: str, flux: str) -> str:
    return f"(12 + 3 * {n * 7 % 5} + {flux}) * exp(-0.5 * pow((col - {at_column(line, fiber)}) / 1.3, 2))"


PEAKS_LIGHT = " + ".join(light(n, w, "fiber", "f") for n, w in enumerate(LINES))
#: One more peak than lines, at a column of no line.
FALSE_LIGHT = "6 * exp(-0.5 * pow((col - 40 - fiber % 5) / 1.3, 2))"
ARCS = f"(SELECT exp, fiber, col, {PEAKS_LIGHT} + {FALSE_LIGHT} AS flux FROM (SELECT exp, rw AS fiber, abs(flux) AS f, i AS col FROM {ORDERED}, range({COLUMNS}) r(i) WHERE idx = 0))"


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(spark, sf_dir).where("idx = 0").withColumn("fiber", F.row_number().over(Window.partitionBy("exp").orderBy("fiber")) - 1)
    # a fiber's row becomes a spectrum of many: few small rows are else left to one task
    rows = dealt(rows.select("exp", "fiber", F.abs("flux").alias("f")), "exp", "fiber")
    rows = rows.select("exp", "fiber", "f", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1))).alias("col"))
    return rows.select("exp", "fiber", "col", F.expr(f"{PEAKS_LIGHT} + {FALSE_LIGHT}").alias("flux"))


def found_sql(src: str) -> str:
    return f"""(SELECT exp, fiber, flux, col - (b - a) / (2 * (b - 2 * flux + a)) AS peak FROM (SELECT *, lag(flux) OVER w AS a, lead(flux) OVER w AS b FROM {src} WINDOW w AS (PARTITION BY exp, fiber ORDER BY col))
    WHERE flux > a AND flux > b AND flux > 1)"""


APART = apart_sql(found_sql(ARCS), "exp, fiber", "peak", "flux", LIMITS["separation"], LIMITS["most"])
SUBSETS = f"""(WITH l AS (SELECT unnest({list(LINES)}::DOUBLE[]) AS w) SELECT row_number() OVER (ORDER BY a.w, b.w, c.w, d.w, e.w, f.w) - 1 AS subset, [a.w, b.w, c.w, d.w, e.w, f.w] AS y
    FROM l a JOIN l b ON b.w > a.w JOIN l c ON c.w > b.w JOIN l d ON d.w > c.w JOIN l e ON e.w > d.w JOIN l f ON f.w > e.w)"""
BRIGHT = f"""(SELECT exp, fiber, subset, x, y[k] AS y FROM (SELECT exp, fiber, peak AS x, row_number() OVER (PARTITION BY exp, fiber ORDER BY peak) AS k, count(*) OVER (PARTITION BY exp, fiber) AS n FROM
    (SELECT * FROM {APART} QUALIFY row_number() OVER (PARTITION BY exp, fiber ORDER BY flux DESC, peak) <= 6)), {SUBSETS} WHERE n = 6)"""
TRIED = f"""(SELECT exp, fiber, subset, sqrt(avg(pow(list_min(list_transform({list(LINES)}::DOUBLE[], lambda w: abs(w - m))), 2))) AS rms FROM {poly_sql(BRIGHT, ['exp', 'fiber', 'subset'], 'x', 'y', 2, 'm')} GROUP BY 1, 2, 3)"""


@query(f"SELECT exp, fiber, subset, {s6('rms')} AS rms FROM {TRIED}")
def fit_arc_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each ordered subset of the lines goes with the brightest peaks of each fiber's arc."""
    peaks = windows.local_peaks(arcs(spark, sf_dir), ["exp", "fiber"], "col", "flux", 1.0)
    apart = windows.suppress_close(peaks, ["exp", "fiber"], "peak", "flux", LIMITS["separation"], LIMITS["most"])
    return rounded(wavelengths.anchor_fits(apart, ["exp", "fiber"], "peak", "flux", LINES).select("exp", "fiber", "subset", "rms"))


def matched_sql(known: str, degree: int) -> str:
    """Peaks with the lines that a polynomial through the known pairs (exp, fiber, peak, line, lo, hi) finds for them.

    The slope is that of the model between two places close to the peak.
    """
    step = 1e-3
    rows = f"""(SELECT exp, fiber, peak AS x, line, lo, hi, 0 AS kind FROM {known} UNION ALL SELECT p.exp, p.fiber, p.peak + d, NULL, lo, hi, 1 + (d > 0)::INT + 2 * (d < 0)::INT
        FROM {APART} p JOIN (SELECT DISTINCT exp, fiber, lo, hi FROM {known}) USING (exp, fiber), (VALUES (0.0), ({step}), (-{step})) v(d))"""
    model = poly_sql(rows, ["exp", "fiber"], "x", "line", degree, "m", span=("lo", "hi"))
    wide = f"""(SELECT exp, fiber, x AS peak, m, lo, hi, (lead(m) OVER w - lag(m) OVER w) / {2 * step} AS s, kind FROM {model} WHERE kind > 0 WINDOW w AS (PARTITION BY exp, fiber ORDER BY x))"""
    near = f"""(SELECT exp, fiber, peak, lo, hi, w AS line, m - w AS residual, abs(s) AS s FROM {wide}, (SELECT unnest({list(LINES)}::DOUBLE[]) AS w) WHERE kind = 1 AND m IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY exp, fiber, w ORDER BY abs(m - w), peak) = 1)"""
    return f"(SELECT * FROM {near} WHERE abs(residual) / s <= {LIMITS['tolerance']} QUALIFY row_number() OVER (PARTITION BY exp, fiber, peak ORDER BY line) = 1)"


BEST = f"""(SELECT exp, fiber, x AS peak, y AS line, min(x) OVER (PARTITION BY exp, fiber) AS lo, max(x) OVER (PARTITION BY exp, fiber) AS hi
    FROM {BRIGHT} JOIN (SELECT exp, fiber, arg_min(subset, [rms, subset]) AS subset FROM {TRIED} GROUP BY 1, 2) USING (exp, fiber, subset))"""


@query(
    f"""WITH first AS (SELECT * FROM {matched_sql(BEST, 2)}), enough AS (SELECT *, count(*) OVER (PARTITION BY exp, fiber) AS n FROM first)
    SELECT exp, fiber, line, {s6('peak')} AS peak, {s6('residual')} AS residual FROM {matched_sql('(SELECT * FROM enough WHERE n >= 5)', 4)}"""
)
def fit_arc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which peak of each fiber's arc is which line."""
    peaks = windows.local_peaks(arcs(spark, sf_dir), ["exp", "fiber"], "col", "flux", 1.0)
    return rounded(wavelengths.identify_arc(peaks, ["exp", "fiber"], "peak", "flux", LINES, **LIMITS)[1])


@query()
def fit_wavelength_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wavelength of every pixel of every fiber of every exposure, from an eighth of its arcs."""
    rows = arcs(spark, sf_dir)
    trace = rows.select("exp", "fiber", "col", F.expr("6 + 8 * fiber + 0.002 * (col - 128)").alias("trace"))
    return rounded(wavelengths.wavelength_map(rows, trace, ["exp"], "flux", LINES, **LIMITS))
