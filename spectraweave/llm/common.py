"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Narrow rows (a few numbers each) that a task of its own is worth.
ROWS_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of this machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="shared-")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rewritten(df: DataFrame, folder: str, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the folder and read again."""
    df.write.parquet(f"{folder}/{name}", compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written copy in the shared checkpoint folder.

    The folder is the one the cluster names in spark.checkpoint.dir; only where
    that is unset (tests, a notebook) a folder of this machine is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def sized(df: DataFrame, rows: int, each: int = ROWS_A_TASK) -> DataFrame:
    """df, of about so many narrow rows, in no more partitions than these need: a task for each shuffle partition costs more than few rows do.

    Two at least, as what follows one partition would not be dealt out again.
    """
    return df.coalesce(max(2, -(-rows // each)))


def with_columns_from(df: DataFrame, source: str, find: Callable[[list], dict[str, pa.Array]], schema: str, drop: bool = False) -> DataFrame:
    """df with columns that find makes from the values of a column, an Arrow batch at a time; they take the place of columns of their names.

    The other columns go along in their Arrow form, so that no value changes. With
    drop, the source column is left out.
    """
    new = StructType.fromDDL(schema)
    taken = {c.lower() for c in new.names} | ({source.lower()} if drop else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    hidden = unused(df, "__from")
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`").alias(hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *[found[n] for n in new.names]], names=[*b.schema.names[: len(kept)], *new.names])

    return rows.mapInArrow(run, StructType([*kept, *new.fields]))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node reachable.

    Alternates the large-star and small-star steps, written as a grouped minimum
    and a join, so that no neighbour list is ever gathered in one row. Stops when
    a round changes nothing. Self links and repeated links are allowed; an empty
    input gives an empty result.
    """
    now = checkpointed(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # no step makes more links than these and their mirror images
        few = partial(sized, rows=2 * state[0])
        now = few(now)
        if state[0] == 0 or tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                few(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            )
        before = tuple(state)
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = few(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        large = checkpointed(few(large))
        low = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = checkpointed(few(few(small.unionByName(low.select("u", F.col("m").alias("v")))).distinct()))
