"""From documents to batches for training: five stages, each on all that the one before has kept.

Every stage but the last returns the columns of ``documents``; where a stage changes texts it sets
n_chars anew. Stages can be run one by one on written tables, or all by ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, linetree, packing, spans, voronoi
from quire.llm.common import prepare, table, written

#: A document goes if its text has no letter, or if its language's posterior is below this.
SURE = 0.5


def _measured(df: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a recognisable language; learns from all labelled ones."""
    prepare(spark)
    told = langid.predict(docs, langid.train(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates but for the first document's; keeps every document.

    Lines that only a few documents share are left to the next stages: taken out here, they would
    leave scraps of near copies that can't be told for what they are.
    """
    prepare(spark)
    return _measured(linetree.dedup(docs, long=None), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies; of those that the line stage has left without a word, being copies, one."""
    prepare(spark)
    return voronoi.representatives(docs, wordless=False)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated spans of sentences out of all documents but the first that has them."""
    prepare(spark)
    return _measured(spans.dedup(docs), docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to length buckets and token-budget batches."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("batches", batches)]

#: Not expressible in SQL (language model, template tree, dynamic programming); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
