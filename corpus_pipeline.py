"""Documents to packed training sequences: STAGES in order, and ``run`` over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm.minhash import drop_near_duplicates
from stridemill.llm.packing import pack_documents
from stridemill.llm.substrings import remove_repeated_windows
from stridemill.llm.toxicity import drop_toxic
from stridemill.plans.registry import table
from stridemill.session import stage

#: A classifier, near duplicates and a packing have no SQL twin; the tests compare with brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more leave; labels are learnt from as in the query."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words seen earlier are cut out of the texts; every document stays."""
    out = remove_repeated_windows(docs, window=20)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in pieces, placed in sequences of 512 to 4,096 words."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
