"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table of a few numbers that is broadcast.
FEW = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of this machine may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """A written copy in the shared checkpoint folder, so that a plan doesn't grow with the rounds.

    The folder is the one named in spark.checkpoint.dir; only where that is
    unset is one of this machine used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt to all shuffle partitions by the columns, for work that is heavy for its bytes.

    Partitions of small rows that grow by a join or an explosion afterwards are
    else merged by size, or come from one file, and leave all to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written copy of df for the right side of a join that has many rows for each of its own: broadcast if its rows are few (FEW, or `most`), else the hashed side of a shuffle.

    Without it the adaptive planner may broadcast the many rows instead, if they
    are finished first: it goes by their bytes as compressed in shuffle files, and
    in the driver repetitive rows are ten times that and more.
    """
    small, most = cut(df), FEW if most is None else most
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small.hint("shuffle_hash")
