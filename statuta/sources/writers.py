"""Writing tables, documents, manifests and published runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.registry import append_with_children, committed
from ..operators.validation import require_equal


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_csv(data: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV with header in a fixed column order; ``single`` for small tables that go to one file."""
    out = data.select(*columns)
    (out.coalesce(1) if single else out).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_json(data: DataFrame, path: str) -> None:
    """One JSON document a row, null fields kept, as text."""
    data.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def marked_text(pages: DataFrame, key: str = "document_id", text: str = "raw_text") -> DataFrame:
    """(key, marked_text): pages in order between document and page marks."""
    page = F.concat(F.lit('<PAGE number="'), F.col("page_number").cast("string"), F.lit('">\n'), F.coalesce(F.col(text), F.lit("")), F.lit("\n</PAGE>"))
    # One document's pages are one row of the result, so they must meet.
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("p")))).alias("ps"))
    return listed.select(key, F.concat(F.lit("<DOCUMENT>\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n</DOCUMENT>")).alias("marked_text"))


def replace_table(data: DataFrame, path: str) -> None:
    data.write.mode("overwrite").parquet(path)


def _moved(spark: SparkSession, staged: str, path: str) -> tuple[Callable[[], None], Callable[[], None]]:
    """Move a written folder into place; (undo, finish): what stood there comes back, or goes."""
    fs, target = _fs(spark, path)
    backup = f"{path}._backup_{uuid.uuid4().hex}"
    held = fs.exists(target)
    if held:
        fs.rename(target, _fs(spark, backup)[1])

    def restore() -> None:
        if held:
            fs.rename(_fs(spark, backup)[1], target)

    def undo() -> None:
        fs.delete(target, True)
        restore()

    if not fs.rename(_fs(spark, staged)[1], target):
        restore()
        raise OSError(f"can't publish {path}")
    return undo, lambda: held and fs.delete(_fs(spark, backup)[1], True)


def _staged(data: DataFrame, path: str, checks) -> str:
    """Write aside, read back, compare and run the checks on what was written."""
    spark, staged = data.sparkSession, f"{path}._staging_{uuid.uuid4().hex}"
    try:
        data.write.parquet(staged)
        written = spark.read.parquet(staged)
        require_equal(data, written)
        for check in checks:
            check(written)
    except Exception:
        _fs(spark, staged)[0].delete(_fs(spark, staged)[1], True)
        raise
    return staged


def publish(data: DataFrame, path: str, checks=()) -> None:
    """Write aside, read back, compare, run the checks on what was written, and only then move into
    place; what stood there comes back if the move fails."""
    _moved(data.sparkSession, _staged(data, path, checks), path)[1]()


def publish_run(data: DataFrame, path: str, events: DataFrame, registry: str, key: str, artifact_registry: str, parents: dict[str, DataFrame] | None = None, checks=()) -> DataFrame:
    """Publish a table and register its run: its files' sizes and hashes as artifact rows, then its event.

    ``events`` is the run's one event row. Files are hashed again after the event stands; if anything
    fails, the table that stood there before comes back. Returns the artifact rows.
    """
    spark = data.sparkSession
    run_id = events.select(F.col(key).cast("string")).first()[0]
    undo, finish = _moved(spark, _staged(data, path, checks), path)
    try:
        found = artifacts(spark, run_id, {"table": path}).withColumnRenamed("run_id", key)
        append_with_children(events, registry, key, {artifact_registry: found}, parents)
        stored = committed(spark.read.parquet(artifact_registry), spark.read.parquet(registry), key).filter(F.col(key) == run_id)
        require_equal(found, stored, ["path", "bytes", "sha256"])
    except Exception:
        undo()
        raise
    finish()
    return stored


def archive(data: DataFrame, root: str, run_id: str) -> str:
    """An immutable copy of a run, compared with ``data``; a second one of the same id is refused."""
    path = f"{root.rstrip('/')}/{run_id}"
    data.write.mode("errorifexists").parquet(path)
    require_equal(data, data.sparkSession.read.parquet(path))
    return path


def artifacts(spark: SparkSession, run_id: str, paths: dict[str, str]) -> DataFrame:
    """(run_id, role, path, bytes, sha256) of files by role, for the registry."""
    out = None
    for role, path in paths.items():
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.lit(run_id).alias("run_id"), F.lit(role).alias("role"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
        out = one if out is None else out.unionByName(one)
    return out


def manifest(spark: SparkSession, **fields) -> DataFrame:
    """One JSON row with sorted keys."""
    return spark.range(1).select(F.to_json(F.struct(*(F.lit(fields[k]).alias(k) for k in sorted(fields)))).alias("manifest"))


def require_manifest(data: DataFrame, required: list[str]) -> None:
    missing = [k for k in required if not data.filter(F.get_json_object("manifest", f"$.{k}").isNull()).isEmpty()]
    if missing:
        raise ValueError(f"manifest lacks {missing}")


def write_report(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """The tables of a report (metrics, confusion, importances, curves) as one folder each, Parquet or CSV, in place of a workbook's sheets."""
    for name, data in tables.items():
        out = data.write.mode("errorifexists")
        out.csv(f"{folder.rstrip('/')}/{name}", header=True, escape='"') if form == "csv" else out.parquet(f"{folder.rstrip('/')}/{name}")


def partition_manifest(data: DataFrame, key: str, partition: str, label: str, **fields) -> DataFrame:
    """One JSON row: records, records by partition and class, and a digest of each partition's ids.

    The digest is a sum of hashes, the same in whatever order the rows come.
    """
    name = lambda c: F.col(c).cast("string")
    digest = F.sum(F.xxhash64(name(key)).cast("decimal(38,0)")).cast("string")
    def named(key_col: str, value: str):
        found = F.map_from_entries(F.collect_list(F.struct(key_col, value)))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(found)), lambda k: F.struct(k.alias("k"), F.element_at(found, k).alias("v"))))

    # A row a partition and class.
    cells = data.groupBy(F.coalesce(name(partition), F.lit("")).alias("p"), F.coalesce(name(label), F.lit("")).alias("l")).agg(F.count("*").alias("n"), digest.alias("d"))
    parts = cells.groupBy("p").agg(F.sum("n").alias("all"), F.sum(F.col("d").cast("decimal(38,0)")).cast("string").alias("digest"), named("l", "n").alias("by"))
    whole = parts.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("records"), named("p", "all").alias("partitions"), named("p", "by").alias("classes"), named("p", "digest").alias("membership"))
    more = [F.lit(fields[k]).alias(k) for k in sorted(fields)]
    return whole.select(F.to_json(F.struct("classes", "membership", "partitions", "records", *more)).alias("manifest"))


def require_membership(manifest_row: DataFrame, data: DataFrame, key: str, partition: str, label: str) -> None:
    """The manifest's counts and digests are those of ``data``."""
    shape = "classes map<string, map<string, long>>, membership map<string, string>, partitions map<string, long>, records long"
    read = lambda m: m.select(F.from_json("manifest", shape).alias("m")).select("m.*").first()
    if read(manifest_row) != read(partition_manifest(data, key, partition, label)):
        raise ValueError("the manifest doesn't fit the records")


def save_model(model, path: str) -> None:
    model.write().save(path)
