"""Extraction quality of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

NEAR_BLANK = 50
# The notes of a page's reason; the first reason that holds is the page's.
BLANK_NOTE = "No text was extracted from this page. The page may be empty, scanned, image-based, or affected by extraction failure."
NEAR_BLANK_NOTE = (
    "The extracted text is below the near-blank threshold (%d < %d non-space characters). "
    "The page may contain a table, figure, signature, stamp, scanned content, or another complex layout."
)
REPLACEMENT_NOTE = "The replacement character � was detected. This may indicate an encoding problem that should not be automatically corrected without inspection."


def review_reason(raw: Column, nonspace: Column, replaced: Column, threshold: int = NEAR_BLANK) -> Column:
    """Struct (requires_manual_review, review_reason_code, review_reason_note, quality_status)."""

    def verdict(flag: bool, code: str, note: Column, status: str) -> Column:
        return F.struct(F.lit(flag).alias("requires_manual_review"), F.lit(code).alias("review_reason_code"), note.cast("string").alias("review_reason_note"), F.lit(status).alias("quality_status"))

    near = F.format_string(NEAR_BLANK_NOTE, nonspace, F.lit(threshold))
    return (
        F.when(X.is_blank(raw), verdict(True, "blank_extraction", F.lit(BLANK_NOTE), "blank_extraction"))
        .when(nonspace < threshold, verdict(True, "near_blank_extraction", near, "near_blank_extraction"))
        .when(replaced > 0, verdict(True, "replacement_character", F.lit(REPLACEMENT_NOTE), "requires_review"))
        .otherwise(verdict(False, "none", F.lit(None), "text_extracted"))
    )


def assess_pages(pages: DataFrame, text_col: str = "raw_text", threshold: int = NEAR_BLANK, ref_compat: bool = False) -> DataFrame:
    """``pages`` with counts and review flags of each page; ``ref_compat`` counts U+FFFD twice."""
    raw = F.col(text_col)
    out = pages.withColumns({
        "total_char_count": X.char_count(raw).cast("long"),
        "nonspace_char_count": X.nonspace_char_count(raw).cast("long"),
        "word_count": X.word_count(raw).cast("long"),
        "line_count": X.line_count(raw).cast("long"),
        "replacement_char_count": X.replacement_char_count(raw, ref_compat).cast("long"),
    })
    out = out.withColumn("__reason", review_reason(raw, F.col("nonspace_char_count"), F.col("replacement_char_count"), threshold))
    flags = {"blank_extraction": X.is_blank(raw), "near_blank_extraction": ~X.is_blank(raw) & (F.col("nonspace_char_count") < threshold)}
    return out.withColumns(flags).select("*", "__reason.*").drop("__reason").withColumn("notes", F.col("review_reason_note"))


def reason_summary(codes: DataFrame, key: str, code_col: str, name: str = "summary") -> DataFrame:
    """'code: n; ...' of each key in code order; keys with no code but 'none' have no row."""
    counted = codes.filter(F.col(code_col).isNotNull() & (F.col(code_col) != "none")).groupBy(key, code_col).agg(F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(code_col).alias("c"), "n"))), lambda x: F.concat(x["c"], F.lit(": "), x["n"].cast("string"))), "; ")
    return counted.groupBy(key).agg(joined.alias(name))


def document_quality(assessed: DataFrame, key: str = "document_id", expected: DataFrame | None = None) -> DataFrame:
    """One row a document: page counts, non-space minimum, maximum and mean, reasons, status.

    ``expected`` (key, expected_page_count) adds whether all pages were seen.
    """
    flag = lambda c: F.count_if(F.col(c))
    summed = assessed.groupBy(key).agg(
        F.count("*").alias("page_count"),
        flag("blank_extraction").alias("blank_pages"),
        flag("near_blank_extraction").alias("near_blank_pages"),
        F.count_if(F.col("replacement_char_count") > 0).alias("replacement_pages"),
        flag("requires_manual_review").alias("review_pages"),
        F.min("nonspace_char_count").alias("min_nonspace"),
        F.max("nonspace_char_count").alias("max_nonspace"),
        F.bround(F.avg("nonspace_char_count"), 2).alias("mean_nonspace"),
    )
    out = summed.join(reason_summary(assessed, key, "review_reason_code", "review_reasons"), key, "left")
    complete = F.lit(True)
    if expected is not None:
        out = out.join(expected.select(key, "expected_page_count"), key, "left").withColumn("page_count_matches", F.col("page_count").eqNullSafe(F.col("expected_page_count")))
        complete = F.col("page_count_matches")
    return out.withColumn("status", F.when((F.col("review_pages") > 0) | ~complete, "Completed with warnings").otherwise("Completed"))


def inspect_documents(pages: DataFrame, key: str = "document_id", text_col: str = "raw_text", threshold: int = NEAR_BLANK) -> DataFrame:
    """Text layer of each document: pages, pages with text, Searchable, Scanned or Mixed."""
    size = F.length(X.python_strip(F.coalesce(F.col(text_col), F.lit(""))))
    out = pages.groupBy(key).agg(F.count("*").alias("page_count"), F.count_if(size >= threshold).alias("extracted_pages"))
    kind = F.when(F.col("extracted_pages") == F.col("page_count"), "Searchable PDF").when(F.col("extracted_pages") == 0, "Scanned PDF").otherwise("Mixed PDF")
    return out.withColumn("original_file_format", kind).withColumn("document_status", F.when(kind == "Searchable PDF", "Ready for processing").otherwise("Requires manual review"))


def with_assessments(documents: DataFrame, assessed: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents (key, pages: array of structs with page_number) with each page's assessment written into it.

    Pages meet their assessment by number and go back in their order; one without an assessment
    has nulls, a document without pages an empty array.
    """
    found = [c for c in ("nonspace_char_count", "requires_manual_review", "review_reason_code", "review_reason_note") if c in assessed.columns]
    pages = documents.select(key, F.explode("pages").alias("p")).select(key, "p", F.col("p.page_number").alias("page_number"))
    met = pages.join(assessed.select(key, "page_number", *found), [key, "page_number"], "left")
    page = F.struct("page_number", F.struct("p.*", *found).alias("page"))
    back = met.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(page)), lambda x: x["page"]).alias("assessed_pages"))
    return documents.join(back, key, "left").withColumn("pages", F.coalesce("assessed_pages", F.expr(f"cast(array() as {back.schema['assessed_pages'].dataType.simpleString()})"))).drop("assessed_pages")
