"""Grouped model fits: Spark gathers the sums, small solves come after.

Least squares needs only sums of products by group, which are taken map-side; the
solve of a few unknowns runs on those sums, one row a group, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sky import to_plane
from .lineage import cut
from .robust import MAD_TO_SIGMA, median


def linear_fit(df: DataFrame, keys: Sequence[str], terms: Sequence[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """(keys, coef array, n): least squares of y on the terms by keys; NULL coefficients where they aren't determined."""
    k = len(terms)
    w = F.lit(1.0) if weight is None else weight
    good = y.isNotNull()
    for t in terms:
        good = good & t.isNotNull()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.where(good).groupBy(*keys).agg(
        F.array(*[F.sum(w * terms[i] * terms[j]) for i, j in pairs]).alias("__a"), F.array(*[F.sum(w * t * y) for t in terms]).alias("__b"), F.count("*").alias("n")
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            coef = []
            for a, b, n in zip(f["__a"], f["__b"], f["n"]):
                m = np.zeros((k, k))
                for (i, j), x in zip(pairs, a):
                    m[i, j] = m[j, i] = x
                ok = n >= k and np.isfinite(m).all() and np.linalg.matrix_rank(m) == k
                coef.append(np.linalg.solve(m, np.array(b, float)).tolist() if ok else None)
            yield f.drop(columns=["__a", "__b"]).assign(coef=coef)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if not f.name.startswith("__"))
    return sums.mapInPandas(solve, f"{schema}, coef array<double>").select(*keys, "coef", "n")


def powers(x: Column, degree: int) -> list[Column]:
    return [F.lit(1.0)] + [F.pow(x, n) if n > 1 else x.cast("double") for n in range(1, degree + 1)]


def evaluate(coef: Column, terms: Sequence[Column]) -> Column:
    return sum((F.get(coef, F.lit(i)) * t for i, t in enumerate(terms)), F.lit(0.0))


def poly_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int, weight: Column | None = None, out: str = "model") -> DataFrame:
    """Adds a polynomial's value, fitted by keys on x scaled to [-1, 1] over the key's range."""
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    rows = df.join(ends, list(keys), "left") if keys else df.crossJoin(ends)
    scaled = F.coalesce(F.try_divide(2 * (F.col(x) - F.col("__lo")), F.col("__hi") - F.col("__lo")) - 1, F.lit(0.0))
    rows = rows.withColumn("__u", scaled)
    fit = linear_fit(rows, keys, powers(F.col("__u"), degree), F.col(y), weight).select(*keys, F.col("coef").alias("__coef"))
    both = rows.join(fit, list(keys), "left") if keys else rows.crossJoin(fit)
    return both.withColumn(out, evaluate(F.col("__coef"), powers(F.col("__u"), degree))).select(*df.columns, out)


def robust_poly_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, degree: int, kind: str = "huber", rounds: int = 5, out: str = "model") -> DataFrame:
    """poly_fit reweighted in fixed rounds: Huber (1.35) or Tukey (4.685) weights of residuals over 1.4826 MAD."""
    limit = {"huber": 1.35, "tukey": 4.685}[kind]
    keys, w, terms = list(keys), Window.partitionBy(*keys), powers(F.col("__u"), degree)
    met = lambda rows, few: rows.join(few, keys, "left") if keys else rows.crossJoin(few)
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    scaled = F.coalesce(F.try_divide(2 * (F.col(x) - F.col("__lo")), F.col("__hi") - F.col("__lo")) - 1, F.lit(0.0))
    # the rounds carry only what the fit reads; all other columns meet the last coefficients once
    read = list(dict.fromkeys([*keys, x, y]))
    now = met(df.select(*read).where(F.col(y).isNotNull()), ends).select(*keys, scaled.alias("__u"), F.col(y).alias("__y"), F.lit(1.0).alias("__w"))
    now = cut(now)
    for n in range(rounds):
        fit = linear_fit(now, keys, terms, F.col("__y"), F.col("__w")).select(*keys, F.col("coef").alias("__coef"))
        if n < rounds - 1:
            now = met(now, fit).withColumn("__r", F.abs(F.col("__y") - evaluate(F.col("__coef"), terms)))
            u = F.try_divide(F.col("__r"), median(F.col("__r")).over(w) * MAD_TO_SIGMA)
            now = now.withColumn("__q", u).drop("__w")
            u = F.col("__q")
            weight = F.when(u <= limit, 1.0).otherwise(limit / u) if kind == "huber" else F.when(u < limit, F.pow(1 - F.pow(u / limit, 2), 2)).otherwise(0.0)
            now = cut(now.select(*keys, "__u", "__y", F.coalesce(weight, F.lit(1.0)).alias("__w")))
    curve = met(ends, fit)
    return met(df, cut(curve)).withColumn("__u", scaled).withColumn(out, evaluate(F.col("__coef"), terms)).select(*df.columns, out)


def plane_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, clip: float | None = 3.0, rounds: int = 2, out: str = "plane") -> DataFrame:
    """Adds the plane a + b x + c y fitted to z by keys, points beyond clip * 1.4826 MAD left out after each round."""
    w = Window.partitionBy(*keys)
    terms = [F.lit(1.0), F.col(x), F.col(y)]
    now = df.withColumn("__z", F.col(z).cast("double"))
    for n in range(rounds):
        fit = linear_fit(now, keys, terms, F.col("__z")).select(*keys, F.col("coef").alias("__coef"))
        now = cut(now.drop(out).join(fit, list(keys), "left").withColumn(out, evaluate(F.col("__coef"), terms)).drop("__coef"))
        if clip and n < rounds - 1:
            now = now.withColumn("__r", F.col("__z") - F.col(out)).withColumn("__s", median(F.abs("__r")).over(w) * MAD_TO_SIGMA)
            now = now.withColumn("__z", F.when(F.abs("__r") <= clip * F.col("__s"), F.col("__z"))).drop("__r", "__s")
    return now.select(*df.columns, out)


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, clip: float = 3.0, rounds: int = 2) -> DataFrame:
    """Slope, intercept and count of a clipped straight line by keys, with built-in regression aggregates."""
    w = Window.partitionBy(*keys)
    now = df.withColumn("__y", F.col(y).cast("double"))
    for _ in range(rounds - 1):
        r = F.col("__y") - (F.regr_slope("__y", x).over(w) * F.col(x) + F.regr_intercept("__y", x).over(w))
        now = now.withColumn("__r", r).withColumn("__s", median(F.abs("__r")).over(w) * MAD_TO_SIGMA)
        now = now.withColumn("__y", F.when(F.abs("__r") <= clip * F.col("__s"), F.col("__y")))
    return now.groupBy(*keys).agg(F.regr_slope("__y", x).alias("slope"), F.regr_intercept("__y", x).alias("intercept"), F.count("__y").alias("n"))


def template_scale(df: DataFrame, keys: Sequence[str], y: str, template: str) -> DataFrame:
    """The scale of a template that fits y best: sum(z y) / sum(z^2)."""
    good = F.col(y).isNotNull() & F.col(template).isNotNull()
    return df.where(good).groupBy(*keys).agg(F.try_divide(F.sum(F.col(template) * F.col(y)), F.sum(F.col(template) * F.col(template))).alias("scale"))


def low_rank_projection(df: DataFrame, basis: DataFrame, keys: Sequence[str], i: str, y: str, k: int, out: str = "model") -> DataFrame:
    """Adds the least-squares projection of each spectrum on a basis(i, b0 .. b<k-1>), over its valid bins only."""
    terms = [F.col(f"b{n}") for n in range(k)]
    rows = df.join(basis, i)
    fit = linear_fit(rows, keys, terms, F.col(y)).select(*keys, F.col("coef").alias("__coef"))
    return rows.join(fit, list(keys), "left").withColumn(out, evaluate(F.col("__coef"), terms)).select(*df.columns, out)


def pca_basis(spectra: DataFrame, array: str, k: int) -> tuple[list[list[float]], list[float]]:
    """k principal components of spectra of one length, and their shares of the variance.

    Only a matrix of the spectra's length squared comes to the driver.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="v", outputCol="o").fit(spectra.select(array_to_vector(F.col(array).cast("array<double>")).alias("v")))
    return model.pc.toArray().T.tolist(), model.explainedVariance.toArray().tolist()


def grid_fit(samples: DataFrame, profiles: DataFrame, keys: Sequence[str], x: str, y: str, error: str, param: str, cell: float) -> DataFrame:
    """The profile width with the least chi-square by keys, refined by a parabola.

    profiles(param, cell number, value) is a lookup table of profiles by distance
    in cells; the amplitude is free.
    """
    met = samples.withColumn("__cell", F.round(F.col(x) / cell).cast("long")).join(profiles.withColumnRenamed("cell", "__cell"), "__cell")
    iv = 1 / (F.col(error) * F.col(error))
    sums = met.groupBy(*keys, param).agg(
        F.sum(F.col(y) * F.col(y) * iv).alias("yy"), F.sum(F.col(y) * F.col("value") * iv).alias("ym"), F.sum(F.col("value") * F.col("value") * iv).alias("mm")
    )
    chi = sums.withColumn("chi2", F.col("yy") - F.try_divide(F.col("ym") * F.col("ym"), F.col("mm"))).withColumn("amplitude", F.try_divide(F.col("ym"), F.col("mm")))
    w = Window.partitionBy(*keys).orderBy(param)
    chi = chi.withColumn("__c0", F.lag("chi2").over(w)).withColumn("__c2", F.lead("chi2").over(w)).withColumn("__p2", F.lead(param).over(w))
    best = chi.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("chi2", param))).where("__r = 1")
    shift = F.try_divide(F.col("__c0") - F.col("__c2"), 2 * (F.col("__c0") - 2 * F.col("chi2") + F.col("__c2")))
    return best.select(*keys, param, "chi2", "amplitude", (F.col(param) + F.coalesce(shift * (F.col("__p2") - F.col(param)), F.lit(0.0))).alias("refined"))


def moffat_table(spark_range: DataFrame, widths: Sequence[float], beta: float, cell: float) -> DataFrame:
    """profiles(fwhm, cell, value) of a Moffat profile of unit flux, for the distances of spark_range (ids) in cells."""
    alpha = [(w, w / (2 * np.sqrt(2 ** (1 / beta) - 1))) for w in widths]
    both = spark_range.select(F.col("id").alias("cell"), F.explode(F.array(*[F.struct(F.lit(float(w)).alias("fwhm"), F.lit(float(a)).alias("alpha")) for w, a in alpha])).alias("p"))
    r = F.col("cell") * cell / F.col("p.alpha")
    return both.select("cell", "p.fwhm", ((beta - 1) / (np.pi * F.pow("p.alpha", 2)) * F.pow(1 + r * r, -beta)).alias("value"))


def offset_vote(pairs: DataFrame, keys: Sequence[str], dx: str, dy: str, radius: float, least: int = 4) -> DataFrame:
    """The most voted offset by keys: the mean of the offsets within `radius` of the one that has the most such neighbours.

    Offsets meet on cells of the radius's size.
    """
    cells = pairs.select(*keys, F.col(dx).alias("x"), F.col(dy).alias("y")).withColumn("id", F.struct("x", "y"))
    here = cells.withColumn("cx", F.floor(F.col("x") / radius)).withColumn("cy", F.floor(F.col("y") / radius))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = here.withColumn("s", F.explode(steps)).select(
        *keys, F.col("x").alias("nx"), F.col("y").alias("ny"), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")
    )
    met = here.join(near, [*keys, "cx", "cy"]).where(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2) <= radius * radius)
    votes = met.groupBy(*keys, "x", "y").agg(F.count("*").alias("votes"), F.avg("nx").alias("mx"), F.avg("ny").alias("my"))
    best = votes.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "x", "y"))).where((F.col("__r") == 1) & (F.col("votes") >= least))
    return best.select(*keys, F.col("mx").alias("dx"), F.col("my").alias("dy"), "votes")


def rotation_search(matches: DataFrame, keys: Sequence[str], ra0: Column, dec0: Column, reach: float = 1.0, steps: int = 201) -> DataFrame:
    """The rotation in degrees, of `steps` within +- reach, whose residuals scatter least, and the median shift left.

    matches has the plane positions x, y and the catalog's ra, dec of each pair.
    """
    px, py = to_plane(F.col("ra"), F.col("dec"), ra0, dec0)
    base = matches.withColumn("__px", px).withColumn("__py", py)
    tried = base.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("rotation", -reach + 2 * reach * F.col("__i") / (steps - 1))
    t = F.radians("rotation")
    tried = tried.withColumn("__dx", F.col("__px") * F.cos(t) - F.col("__py") * F.sin(t) - F.col("x")).withColumn("__dy", F.col("__px") * F.sin(t) + F.col("__py") * F.cos(t) - F.col("y"))
    centers = tried.groupBy(*keys, "rotation").agg(median(F.col("__dx")).alias("dx"), median(F.col("__dy")).alias("dy"))
    off = tried.join(centers, [*keys, "rotation"])
    spread = off.groupBy(*keys, "rotation", "dx", "dy").agg(
        (F.sqrt(median(F.abs(F.col("__dx") - F.col("dx"))) * median(F.abs(F.col("__dy") - F.col("dy")))) * MAD_TO_SIGMA).alias("scatter")
    )
    best = Window.partitionBy(*keys).orderBy("scatter", F.abs("rotation"), "rotation")
    return spread.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(*keys, "rotation", "dx", "dy", "scatter")


def cross_correlate(a: DataFrame, b: DataFrame, keys: Sequence[str], i: str, y: str, max_lag: int) -> DataFrame:
    """The lag of b behind a with the largest sum of products by keys, refined by a parabola."""
    lagged = b.select(*keys, F.col(i).alias("__j"), F.col(y).alias("__v")).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    met = a.select(*keys, F.col(i).alias("__i"), F.col(y).alias("__u")).join(lagged.withColumn("__i", F.col("__j") - F.col("lag")), [*keys, "__i"])
    sums = met.groupBy(*keys, "lag").agg(F.sum(F.col("__u") * F.col("__v")).alias("c"))
    w = Window.partitionBy(*keys).orderBy("lag")
    rows = sums.withColumn("__p", F.lag("c").over(w)).withColumn("__n", F.lead("c").over(w))
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "lag"))).where("__r = 1")
    shift = F.try_divide(F.col("__p") - F.col("__n"), 2 * (F.col("__p") - 2 * F.col("c") + F.col("__n")))
    return best.select(*keys, "lag", (F.col("lag") + F.coalesce(shift, F.lit(0.0))).alias("shift"), F.col("c").alias("product"))
