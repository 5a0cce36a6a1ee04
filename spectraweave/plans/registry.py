"""Registry of queries and of the SQL that gives the same rows, and fragments of SQL they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """The columns, doubles to six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not keep or c in keep])


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiber spectra in long form: embeddings as fibers (vec_id), exposures (label) and flux by bin."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fiber"), F.col("label").alias("exp"), F.col("embedding").cast("array<double>").alias("flux"))
    return to_long(df, ["fiber", "exp"], ["flux"], i="idx")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky positions of the fibers, some of them about right ascension 0."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (150 + e[0] / 10).alias("ra"), (2 + e[1] / 10).alias("dec"), e.alias("flux"))


#: The same in SQL.
SPEC = "(SELECT vec_id AS fiber, label AS exp, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS flux FROM embeddings, range(1, 65) r(i))"
POS = "(SELECT vec_id, label, 150 + CAST(embedding[1] AS DOUBLE) / 10 AS ra, 2 + CAST(embedding[2] AS DOUBLE) / 10 AS dec FROM embeddings)"


def s6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def median_sql(x: str) -> str:
    return f"quantile_cont({x}, 0.5)"


def biweight_sql(src: str, keys: Sequence[str], x: str, loc: str = "location", scale: str = "scale", c: float = 9.0) -> str:
    k = ", ".join(keys)
    over = f"OVER (PARTITION BY {k})"
    return (
        f"(SELECT {k}, m0 + coalesce(sum(d * pow(1 - u2, 2)) FILTER (u2 < 1) / nullif(sum(pow(1 - u2, 2)) FILTER (u2 < 1), 0), 0) AS {loc}, "
        f"sqrt(count(*) FILTER (u2 < 1) * sum(d * d * pow(1 - u2, 4)) FILTER (u2 < 1)) / nullif(abs(sum((1 - u2) * (1 - 5 * u2)) FILTER (u2 < 1)), 0) AS {scale} "
        f"FROM (SELECT *, pow(d / nullif({c} * mad, 0), 2) AS u2 FROM (SELECT *, median(abs(d)) {over} AS mad FROM "
        f"(SELECT *, {x} - median({x}) {over} AS d, median({x}) {over} AS m0 FROM {src}))) GROUP BY {k}, m0)"
    )


def mad_sql(src: str, keys: Sequence[str], x: str, out: str = "mad_std") -> str:
    k = ", ".join(keys)
    return f"(SELECT {k}, 1.4826 * median(abs(d)) AS {out} FROM (SELECT *, {x} - median({x}) OVER (PARTITION BY {k}) AS d FROM {src}) GROUP BY {k})"
