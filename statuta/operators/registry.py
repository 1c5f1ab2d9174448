"""Append-only lineage registry: one row a stage run, with ids, parents and status."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: event table -> (key, id prefix, parent columns)
EVENTS = {
    "extraction_events": ("extraction_id", "EXT", ["document_id"]),
    "quality_assessment_events": ("assessment_id", "QA", ["extraction_id", "document_id"]),
    "normalization_events": ("normalization_id", "NORM", ["assessment_id", "extraction_id", "document_id"]),
    "structure_events": ("structure_id", "STRUCT", ["normalization_id", "document_id"]),
    "segmentation_events": ("segmentation_id", "SEG", ["structure_id", "document_id"]),
    "matching_events": ("matching_id", "MATCH", ["segmentation_id", "structure_id", "normalization_id", "document_id"]),
    "split_events": ("split_id", "SPLIT", ["matching_id", "segmentation_id", "document_id"]),
    "vectorization_events": ("vectorization_id", "VECT", ["split_id", "matching_id", "segmentation_id", "document_id"]),
    "model_events": ("model_id", "MODEL", ["vectorization_id", "split_id", "matching_id", "segmentation_id", "document_id"]),
}
COMPLETED = ("Completed", "Completed with warnings")


class RegistryError(ValueError):
    pass


def by_id(events: DataFrame, key: str, value: str) -> DataFrame:
    found = events.filter(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise RegistryError(f"no {key} {value}")
    return found


def latest(events: DataFrame, key: str, created: str = "created_at", completed_only: bool = False, status: str = "status") -> DataFrame:
    """The newest event; the greater id among equals."""
    some = events.filter(F.col(status).isin(*COMPLETED)) if completed_only else events
    return some.orderBy(F.desc(created), F.desc(key)).limit(1)


def latest_per(events: DataFrame, partition: list[str], key: str, created: str = "created_at") -> DataFrame:
    """The newest event of each partition, by a maximum that is taken before anything is shuffled."""
    whole = F.struct(*(F.col(c) for c in events.columns))
    return events.groupBy(*partition).agg(F.max_by(whole, F.struct(created, key)).alias("e")).select("e.*")


def next_id(events: DataFrame, key: str, prefix: str, strict: bool = False) -> DataFrame:
    """One row next_id: the greatest number + 1. ``strict`` raises on an id of another form, else it is passed over."""
    form = rf"^{prefix}_(\d+)$"
    if strict and not events.filter(F.col(key).isNotNull() & ~F.col(key).rlike(form)).isEmpty():
        raise RegistryError(f"{key} of another form than {prefix}_n")
    number = F.try_to_number(F.nullif(F.regexp_extract(key, form, 1), F.lit("")), F.lit("9" * 18)).cast("long")
    return events.agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("n")).select(F.format_string(f"{prefix}_%06d", "n").alias("next_id"))


def lineage_breaks(child: DataFrame, parent: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Child events whose ``fields`` differ from their parent's, or that have no parent."""
    p = parent.select(F.col(key), *(F.col(f).alias(f"parent_{f}") for f in fields), F.lit(True).alias("known"))
    met = child.join(p, key, "left")
    differs = F.col("known").isNull()
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"parent_{f}"))
    return met.filter(differs).drop("known")


def in_list(elements: DataFrame, column: str, values: list[str], order: str) -> DataFrame:
    return elements.filter(F.col(column).isin(values)).orderBy(order)


def coalesce_metadata(primary: DataFrame, secondary: DataFrame, key: str, names: list[str], primary_first: bool = True) -> DataFrame:
    """First non-null of two sources of document metadata."""
    b = secondary.select(key, *(F.col(n).alias(f"__{n}") for n in names))
    pick = lambda n: F.coalesce(n, f"__{n}") if primary_first else F.coalesce(f"__{n}", n)
    return primary.select(key, *names).join(b, key, "full").select(key, *(pick(n).alias(n) for n in names))


def key_violations(events: DataFrame, key: list[str]) -> DataFrame:
    return events.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def reference_violations(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    return child.filter(F.col(column).isNotNull()).join(parent.select(column).distinct(), column, "left_anti")


def check_violations(events: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check_name, violations): rows on which a check is false; null passes, as in SQL."""
    summed = events.agg(*(F.count_if(~c).alias(name) for name, c in checks.items()))
    cells = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks))
    return summed.select(F.inline(cells))


def is_json(c: Column | str) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.try_parse_json(text).isNotNull()


def require_appendable(events: DataFrame, path: str, key: str, parents: dict[str, DataFrame] | None = None) -> None:
    """The keys stand once and are new, and the parents are known."""
    spark = events.sparkSession
    if not key_violations(events, [key]).isEmpty():
        raise RegistryError(f"repeated {key}")
    try:
        known = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = None
    if known is not None and not events.join(known.select(key), key, "left_semi").isEmpty():
        raise RegistryError(f"{key} is registered")
    for column, parent in (parents or {}).items():
        if not reference_violations(events, parent, column).isEmpty():
            raise RegistryError(f"unknown {column}")


def append(events: DataFrame, path: str, key: str, parents: dict[str, DataFrame] | None = None) -> None:
    """Append event rows after their keys and parents are checked; files appear in one commit.

    For one writer at a time: two that check at once may both append. ``sources.commit_log`` holds
    against that.
    """
    require_appendable(events, path, key, parents)
    events.write.mode("append").parquet(path)


#: Names the try that wrote child rows; the event row names the one that counts.
ATTEMPT = "attempt_id"


def append_with_children(events: DataFrame, path: str, key: str, children: dict[str, DataFrame], parents: dict[str, DataFrame] | None = None) -> None:
    """Append child rows (path -> rows that hold ``key``) and then the events: the event is the commit.

    Everything is checked before anything is written, and rows of another event are refused. Child
    rows carry the id of this try, and so does the event: what a run left that stopped in between, or
    another one wrote for the same key, is passed over by ``committed``.
    """
    for rows in children.values():
        if not rows.join(events.select(key), key, "left_anti").isEmpty():
            raise RegistryError(f"child rows of another {key}")
    require_appendable(events, path, key, parents)
    attempt = F.lit(uuid.uuid4().hex)
    for child_path, rows in children.items():
        rows.withColumn(ATTEMPT, attempt).write.mode("append").parquet(child_path)
    append(events.withColumn(ATTEMPT, attempt), path, key, parents)


def committed(children: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Child rows whose event is registered, and by the same try where both sides name it."""
    keys = [key, *([ATTEMPT] if ATTEMPT in children.columns and ATTEMPT in events.columns else [])]
    return children.join(events.select(*keys).distinct(), keys, "left_semi")


def prior_model(events: DataFrame, group: str, configurations: list[str], designation: str = "Model A", key: str = "model_id", created: str = "created_at", status: str = "model_status", metrics: str = "final_test_metrics_json") -> DataFrame:
    """The newest completed event of ``designation`` in each ``group`` whose JSON reports exactly these configurations."""
    reported = F.from_json(F.get_json_object(metrics, "$.held_out_reported_configurations"), "array<string>")
    wanted = F.array(*map(F.lit, sorted(configurations)))
    some = events.filter((F.col("model_designation") == designation) & (F.col(status) == "Completed") & (F.array_sort(F.array_distinct(reported)) == wanted))
    return latest_per(some, [group], key, created)


def prior_results(events: DataFrame, key: str = "model_id", metrics: str = "final_test_metrics_json") -> DataFrame:
    """(key, configuration_id, metric, value): held-out results out of the events' JSON."""
    shape = "map<string, struct<configuration_label: string, overall: map<string, double>>>"
    read = events.select(key, F.explode(F.from_json(F.get_json_object(metrics, "$.configurations"), shape)).alias("configuration_id", "c"))
    return read.select(key, "configuration_id", F.explode("c.overall").alias("metric", "value"))
