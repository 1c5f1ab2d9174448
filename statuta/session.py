"""Session helpers: defaults for local runs, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine; a cluster's own session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("statuta")
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Most rows of an Arrow batch: texts may be long, and both sides of a Python worker hold several batches.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold ``BATCH_ROWS`` rows at most, also those of results that are written later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes of the longest method that the JVM compiles; longer ones of generated code are interpreted for good.
METHOD_BYTES = 8000


def bounded_methods(spark: SparkSession) -> None:
    """Steps of this session whose generated code would not be compiled run as shorter methods instead."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python needs no install."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="statuta-zip-"), "statuta_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the folder that the cluster shares; its lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``; only a session of one process gets one of
    its own where none is set. Spark removes the files when the result is no longer referenced, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError(f"set spark.checkpoint.dir to a folder that all hosts of {sc.master} see")
            folder = "file://" + tempfile.mkdtemp(prefix="statuta-checkpoints-")
            df.sparkSession.conf.set("spark.checkpoint.dir", folder)
        sc.setCheckpointDir(folder)
    return df.checkpoint()
