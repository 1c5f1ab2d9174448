"""Scratch tables in the folder that the whole cluster sees, and small helpers.

Intermediate results that are read more than once are written as Parquet under
``spark.checkpoint.dir`` and read back: that cuts the lineage, survives lost executors and
lets later steps read only the columns they need.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import bounded_batches  # noqa: F401  the operators take it from here

_U = np.uint64
_scopes: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one if the session runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all hosts of {master} see")
        found = "file://" + tempfile.mkdtemp(prefix="statuta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call. ``drop`` frees one early; the rest goes with its scope, or when the driver exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        bounded_batches(spark)
        atexit.register(self.close)
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """``parts``: files of a table known to be small; what makes it still runs in as many tasks as it likes."""
        path = f"{self.base}/{name}"
        (df if parts is None else df.repartition(parts)).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.base}/{name}")

    def close(self) -> None:
        with suppress(Exception):  # the JVM may be gone at exit
            delete(self.spark, self.base)
        atexit.unregister(self.close)


@contextmanager
def freed() -> Iterator[None]:
    """Tables of the operators called inside go at its end: their result must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            made.close()


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` (compared without case) has."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join for tables that grow with the corpus, with a shuffle of its own on both sides.

    Where ``right`` is an aggregate by the keys, a plain join would share its shuffle, and adaptive
    execution couldn't split a hot key; a hash of the keys beside them makes the join's shuffle
    another one. Neither side is broadcast.
    """
    also = free_name([*left.columns, *right.columns], "key_hash")
    hashed = lambda df: df.withColumn(also, F.xxhash64(*keys))
    return hashed(left).join(hashed(right).hint("merge"), [*keys, also], how).drop(also)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))
