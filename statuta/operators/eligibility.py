"""Which reviewed records may be used, and checks of their counts and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import patterns as P, text as X


def with_reasons(data: DataFrame, include: str = "include_in_final_set", label: str = "reviewer_gold_label", text: str = "candidate_text_original", key: str = "candidate_id", classes: list[str] = P.CLASSES) -> DataFrame:
    """``data`` with exclusion_reasons, all that hold joined by '; ' and empty for eligible records."""
    chosen = X.normalize_category(include)
    reasons = F.array_compact(F.array(
        F.when(chosen != "yes", F.concat(F.lit("include_in_final_set_"), F.when(chosen == "", "blank").otherwise(chosen))),
        F.when(~X.normalize_category(label).isin(classes), "invalid_reviewer_gold_label"),
        F.when(X.is_blank(text), "blank_candidate_text_original"),
        F.when(X.is_blank(key), "blank_candidate_id"),
    ))
    return data.withColumn("exclusion_reasons", F.array_join(reasons, "; "))


def eligible(data: DataFrame, label: str = "reviewer_gold_label", **columns) -> DataFrame:
    return with_reasons(data, label=label, **columns).filter("exclusion_reasons = ''").drop("exclusion_reasons").withColumn(label, X.normalize_category(label))


def excluded(data: DataFrame, **columns) -> DataFrame:
    return with_reasons(data, **columns).filter("exclusion_reasons <> ''")


def reason_counts(data: DataFrame, **columns) -> DataFrame:
    one = with_reasons(data, **columns).filter("exclusion_reasons <> ''").select(F.explode(F.split("exclusion_reasons", "; ")).alias("reason"))
    return one.groupBy("reason").agg(F.count("*").alias("n"))


def class_counts(data: DataFrame, label: str, classes: list[str] = P.CLASSES) -> DataFrame:
    """Counts in class order, zero where a class has no record."""
    spark = data.sparkSession
    order = spark.createDataFrame(list(enumerate(classes)), "class_order int, label string")
    counted = data.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counted, "label", "left").select("class_order", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_mismatches(data: DataFrame, columns: list[str], expected: DataFrame) -> DataFrame:
    """(columns, expected, observed) where the counts differ; values without an expectation expect 0."""
    seen = data.groupBy(*columns).agg(F.count("*").alias("observed"))
    met = seen.join(expected.select(*columns, "expected"), columns, "full")
    out = met.select(*columns, F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return out.filter("expected <> observed")


def policy_check(data: DataFrame, label: str, expected_total: int, expected: dict[str, int], classes: list[str] = P.CLASSES) -> DataFrame:
    """(item, expected, observed, passed) of eligible records against the policy's counts: all, then each class."""
    wanted = [("eligible_records", expected_total), *((f"{label}.{c}", expected.get(c, 0)) for c in classes)]
    order = data.sparkSession.createDataFrame([(k, item, int(n)) for k, (item, n) in enumerate(wanted)], "at int, item string, expected long")
    seen = data.groupBy(F.concat(F.lit(f"{label}."), F.col(label)).alias("item")).agg(F.count("*").alias("observed"))
    seen = seen.unionByName(data.agg(F.count("*").alias("observed")).withColumn("item", F.lit("eligible_records")))
    met = F.broadcast(order).join(seen, "item", "left").withColumn("observed", F.coalesce("observed", F.lit(0)).cast("long"))  # one row a class
    return met.select("item", "expected", "observed", (F.col("expected") == F.col("observed")).alias("passed"))


def id_uniqueness(data: DataFrame, key: str) -> DataFrame:
    """rows, nonblank, distinct, blank, duplicated ids."""
    blank = X.is_blank(F.col(key).cast("string"))
    per = data.filter(~blank).groupBy(key).agg(F.count("*").alias("n"))
    ids = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nonblank_ids"), F.count("*").alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("duplicated_ids"))
    return data.agg(F.count("*").alias("n_rows"), F.count_if(blank).alias("blank_ids")).crossJoin(ids)  # one row each


def table_differences(left: DataFrame, right: DataFrame, key: str, columns: list[str], most: int = 10) -> DataFrame:
    """Up to ``most`` differing cells (key, column, left, right) and ids that one side lacks."""
    a = left.select(F.col(key).cast("string").alias("id"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(X.comparison_value(F.col(c), dict(left.dtypes)[c]) for c in columns))).alias("l"))
    b = right.select(F.col(key).cast("string").alias("id"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(X.comparison_value(F.col(c), dict(right.dtypes)[c]) for c in columns))).alias("r"))
    cells = a.join(b, "id", "full").select("id", "l", "r", F.explode(F.array(*map(F.lit, columns))).alias("column"))
    cells = cells.select("id", "column", F.expr("l[column]").alias("left_value"), F.expr("r[column]").alias("right_value"))
    return cells.filter(~F.col("left_value").eqNullSafe(F.col("right_value"))).orderBy("id", "column").limit(most)
