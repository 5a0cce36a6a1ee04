"""The corpus pipeline: stages that each apply one training-data operator to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it
got; the last adds how often each document is taken. A stage's result is written
as Parquet and read again, so that a lost executor costs no more than a stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraweave.llm import decontaminate, langid, line_dedup, mixing, simhash
from spectraweave.llm.common import rewritten, shared_folder, table, unused

#: A language must have at least this posterior probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts, texts without letters, and those of no likely language.

    The model learns from the documents' own language labels; without any, all
    documents with letters stay. Equal rows stay or go together; an empty table
    gives none; columns of any name are kept as they are.
    """
    model = langid.fit(docs)
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    held = F.struct(*docs.columns).alias("__document")
    found = langid.identify(docs, model, extra=(held,))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("__document.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that an earlier line is near to, and documents of which nothing else is left.

    Null and empty texts stay; equal rows are one document; an empty table gives none.
    """
    gone = unused(docs, "__gone")
    out = line_dedup.deduplicated(docs, removed_col=gone, **line_dedup.WHOLE)
    kept = out.where((F.size(gone) == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies (five words, similarity 0.8), once; documents without an id stay.

    Null and empty texts are copies of each other; of several rows with one id
    the one of the smallest hash of text stays; an empty table gives none.
    """
    number = unused(docs, "__n")
    found = simhash.near_copies(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(first, "doc_id", "left_semi").withColumn(number, F.row_number().over(same)).where(F.col(number) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a run of ten words, or a whole shorter item, with the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with `copies`, their size in words and their source's target, which take the place of columns of these names.

    Null and empty texts have no words and are not taken; rows of one id are taken
    alike; an empty table gives none.
    """
    mixed = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")))
    taken = mixed.where("taken > 0").groupBy(F.col("doc_id").alias("__id")).agg(
        F.struct(F.max(F.col("taken") / F.col("size")).cast("int").alias("copies"), F.max("size").alias("n_words"), F.round(F.max("target"), 6).alias("source_target")).alias("__mix")
    )
    held = docs.select("doc_id", F.struct(*[c for c in docs.columns if c.lower() not in ("copies", "n_words", "source_target")]).alias("__document"))
    return held.join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).select("__document.*", "__mix.*")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The first stage's model has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
