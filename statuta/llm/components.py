"""Connected components by alternating large-star and small-star steps.

Every step is two joins on vertex keys; nothing is gathered on the driver but a row count and
a checksum that tell when the edge set no longer changes. A vertex of very many neighbours is
a hot join key, which adaptive execution can split over many tasks (see ``meet``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, meet

#: More rounds than any graph of 2**60 vertices needs.
MAX_ROUNDS = 120


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links each larger neighbour to the least vertex around; small star each smaller one."""
    if large:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    met = meet(around, least, ["a"])
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b")))
    out = out.filter(F.col("a") != F.col("b"))
    return out if large else out.distinct()


def _seen(edges: DataFrame) -> tuple:
    """Row count and checksum: equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (a, b) -> (node, root): root is the least node of the component.

    Nodes without an edge have no row. Repeated edges, both directions and self loops are fine;
    rows with a null end are left out; no edges give an empty result.
    """
    oriented = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.save(oriented, f"{name}_0")
    last = _seen(now)
    for step in range(1, MAX_ROUNDS):
        nxt = scratch.save(_star(_star(now, True), False), f"{name}_{step}")
        scratch.drop(f"{name}_{step - 1}")
        now, before, last = nxt, last, _seen(nxt)
        if last == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
