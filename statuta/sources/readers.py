"""Reading documents, review sheets, partitions and feature tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fingerprint

PAGE_SCHEMA = "document_id string, page_number int, raw_text string, extraction_method string"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", fingerprint("content").alias("sha256"))


def pages_from_files(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]], method: str = "text_layer") -> DataFrame:
    """Pages of files by ``extract`` (bytes -> page texts), numbered from 1; the document is the file's name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], k, text, method) for p, data in zip(frame.path, frame.content) for k, text in enumerate(extract(data), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "raw_text", "extraction_method"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def pages_from_table(data: DataFrame, document: str, text: str, page: str | None = None) -> DataFrame:
    number = F.col(page).cast("int") if page else F.lit(1)
    return data.select(F.col(document).cast("string").alias("document_id"), number.alias("page_number"), F.col(text).alias("raw_text"), F.lit("table").alias("extraction_method"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of document files that nest them under ``pages``."""
    schema = "document_id string, document_metadata map<string,string>, pages array<struct<page_number:int,raw_text:string,extraction_method:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("document_id", "document_metadata", F.inline("pages"))


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame.content:
            text = bytes(content).decode("utf-8-sig")
            rows = [(k, cells) for k, cells in enumerate(csv.reader(io.StringIO(text, newline="")), 1)]
            yield pd.DataFrame(rows, columns=["_source_row", "cells"])


def sheet(spark: SparkSession, path: str, header_row: int = 1, required: list[str] | None = None) -> DataFrame:
    """A sheet kept as CSV, all text, blanks kept, headers stripped, with its source row number.

    Rows before ``header_row`` (from 1) are passed over. A row is a record: quoted cells may hold
    line feeds, so a sheet (1,048,576 rows at most, as sheets are) is read whole. Short rows are
    filled with blanks; blank or repeated headers get their column's number.
    """
    records = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_records, "_source_row int, cells array<string>")
    header = records.filter(F.col("_source_row") == header_row).first()
    if header is None:
        raise ValueError("no header row")
    names: list[str] = []
    for k, cell in enumerate(header["cells"]):
        name = cell.strip()
        names.append(name if name and name not in names else f"{name or 'column'}_{k}")
    missing = [c for c in required or [] if c not in names]
    if missing:
        raise ValueError(f"missing columns {missing}")
    body = records.filter(F.col("_source_row") > header_row)
    return body.select(*(F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(names)), "_source_row")


def partition(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with header, every cell text, nothing read as missing, required columns present."""
    out = spark.read.csv(path, header=True, inferSchema=False, emptyValue="", nullValue="\0", multiLine=True, escape='"')
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return out.na.fill("")


def require_files(spark: SparkSession, expected: DataFrame) -> None:
    """Files are what the registry's (path, bytes, sha256) say."""
    for path in [r[0] for r in expected.select("path").distinct().collect()]:  # a registered run's few files
        held = fingerprints(spark, path).first()
        wanted = expected.filter(F.col("path") == path).first()
        if held is None or (held["length"], held["sha256"]) != (wanted["bytes"], wanted["sha256"]):
            raise ValueError(f"{path} is not what was registered")


def verified_matrix(spark: SparkSession, values_path: str, features_path: str, rows: int, columns: int, files: DataFrame | None = None) -> DataFrame:
    """Long-form matrix after its shape and index ranges are checked, and its ``files`` (path, bytes, sha256) if given."""
    if files is not None:
        require_files(spark, files)
    values, features = spark.read.parquet(values_path), spark.read.parquet(features_path)
    seen = values.agg(F.max("row_index").alias("r"), F.max("feature_index").alias("c"), F.min("value").alias("lo")).first()
    count = features.agg(F.countDistinct("feature_index").alias("n"), F.max("feature_index").alias("hi")).first()
    if (seen["r"] is not None and (seen["r"] >= rows or seen["c"] >= columns)) or count["n"] != columns or (columns and count["hi"] != columns - 1):
        raise ValueError("the matrix and its feature table don't fit")
    return values
