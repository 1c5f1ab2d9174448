"""Equality and set checks between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def differences(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, with their multiplicity, that one side has and the other lacks: (side, columns)."""
    names = columns or a.columns
    x, y = a.select(*names), b.select(*names)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def require_equal(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> None:
    found = differences(a, b, columns).limit(10).collect()
    if found:
        raise ValueError("tables differ: " + "; ".join(map(str, found)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only one side has."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("only_in", F.lit("left"))
    return left.unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("only_in", F.lit("right")))


def partition_counts(assignments: DataFrame, run: str, partition: str, expected: DataFrame) -> DataFrame:
    """(run, partition, expected, observed) of registered assignments whose counts differ from the run's.

    ``expected``: run, partition, expected; a partition that either side lacks counts zero there.
    """
    seen = assignments.groupBy(run, partition).agg(F.count("*").alias("observed"))
    met = seen.join(expected.select(run, partition, "expected"), [run, partition], "full")
    out = met.select(run, partition, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return out.filter("expected <> observed")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join after both sides are shown to hold a key once; the optimizer chooses how."""
    for side in (left, right):
        if not side.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"repeated {key}")
    return left.join(right, key, "left")
