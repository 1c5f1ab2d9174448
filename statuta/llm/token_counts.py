"""Token counts through a digest cache.

A text's key is the SHA-256 of its content (null as empty; this vocabulary normalises nothing, so
content is taken as it is) and the tokenizer version is the SHA-256 of its file. Stored counts are
joined by key; only distinct texts without a stored count are encoded, and their counts are
appended to the cache in one committed write.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Scratch, meet
from .tokens import text_counts, tokenizer_path
from .words import pieces

CACHE_SCHEMA = "digest binary, n_tokens long"


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = text_counts(path)
        for batch in batches:
            for part in pieces(batch, 1, 256):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.count_all(part.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def token_counts(docs: DataFrame, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder that all executors see, kept between calls; without one a new cache is
    used for this call. Null text counts as empty and has no token. Repeated rows and ids each
    get a row; an empty table gives none and stores nothing. Other columns are ignored.
    """
    spark, path = docs.sparkSession, tokenizer_path(tokenizer)
    scratch = Scratch(spark, "token-counts")
    version = hashlib.sha256(Path(path).read_bytes()).hexdigest()[:32]
    stored = f"{(cache or scratch.base + '/cache').rstrip('/')}/{version}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    missing = src.select("digest", "text")
    if _exists(spark, stored):
        missing = missing.join(spark.read.schema(CACHE_SCHEMA).parquet(stored).select("digest"), "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))
    distinct.mapInArrow(_counted(path), CACHE_SCHEMA).write.mode("append").parquet(stored)

    # Two calls at once may both append a text; their counts are equal.
    known = spark.read.schema(CACHE_SCHEMA).parquet(stored).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    keys = src.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return meet(keys, known, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
