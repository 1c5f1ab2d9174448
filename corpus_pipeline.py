"""A corpus pipeline: five stages, each a training-data operator over what the last one kept.

Quality rules, line dedup, near-dedup and mixing return the columns of ``documents``; packing
returns the pieces of the training sequences. A stage's decisions take effect in its result:
rejected documents and near duplicates are gone, recurring lines are out of the texts (with
``n_chars`` made anew), and documents stand as often as their source's weight drew them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from statuta.llm.line_dedup import dedup_lines
from statuta.llm.mixing import mix_sources
from statuta.llm.near_dup import keep_one
from statuta.llm.packing import pack_documents
from statuta.llm.quality import keep_good
from statuta.llm.shared import Scratch, freed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that the rules keep. Null and empty texts go; repeated rows are judged alike."""
    return keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: recurring lines out of all but their first document. No row goes; null texts stay null and have no n_chars."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 at a similarity of 0.8: the least id of each group stays, and every null id or empty text."""
    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as its source's rate draws it, in hashed order. A null source is one of its own."""
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all copies in sequences of 2,048 tokens. A null or empty text is its end id alone."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The estimates of stage 1 and the sketches of stage 3 are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again, and its
    working tables and the result before it are freed then. An empty table gives no piece."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with freed():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
