"""The queries of the training-data operators; each hands whole tables to its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ball_tree import top_k
from .divergence import divergence_sql, source_divergence
from .html_extract import extract_text
from .license_scan import license_scan, scan_sql
from .line_dedup import dedup_lines, dedup_sql
from .mixing import mix_sources, mixed_sql
from .near_dup import near_dup_groups
from .packing import pack_documents
from .part_codes import codes_sql, part_codes
from .personal_data import digests, find_personal_data
from .quality import quality_verdicts
from .token_counts import token_counts
from .url_filter import url_verdicts, verdicts_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(table(spark, sf_dir, "documents"), threshold_pct=85)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), counts=("copies", "copy", "place")).select("doc_id", "text", "lang", "source", "n_chars", "copies", "copy", "place")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "lang", "source", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_lines", "n_dropped")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_personal_data(table(spark, sf_dir, "documents")))


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes(table(spark, sf_dir, "embeddings"))


def top_k_sql() -> str:
    fine = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings where vec_id is not null and {fine}),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_minhash_near_dedup, op2_quality_rules, op3_packing, op4_license_scan, op5_source_mixing, op6_line_dedup, op7_html_extraction, op8_url_filter, op9_exact_top_k, op10_token_counts, op11_source_divergence, op12_personal_data, op13_part_codes)
}
ORACLES: dict[str, str] = {
    "op4_license_scan": scan_sql(),
    "op5_source_mixing": mixed_sql(),
    "op6_line_dedup": dedup_sql(),
    "op8_url_filter": verdicts_sql(),
    "op9_exact_top_k": top_k_sql(),
    "op11_source_divergence": divergence_sql(),
    "op13_part_codes": codes_sql(),
}
