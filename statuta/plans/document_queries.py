"""Pages and documents: scans, quality, text functions, normalization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import patterns as P, text as X
from ..functions.unicode import html_unescape, matching_text, nfc, nfkc, strip_accents
from ..operators import normalize as N, page_quality as Q
from ..operators.segments import with_next
from ..operators.structure import logical_lines
from ..sources import readers, writers
from .base import query, table

_NONSPACE = r"length(regexp_replace(text, '[\s\x0b\x1c-\x1f\x85   -     　]+', '', 'g'))"
_STRIPPED = r"regexp_replace(text, '^[\s\x0b ]+|[\s\x0b ]+$', '', 'g')"
_COUNTS = rf"""
  select doc_id, source, length(text) as total_char_count, {_NONSPACE} as nonspace_char_count,
    cast(len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+')) as bigint) as word_count,
    case when text = '' then 0 else cast(len(string_split(case when ends_with(text, chr(10)) then text[:-2] else text end, chr(10))) as bigint) end as line_count,
    length(text) - length(replace(text, chr(65533), '')) as replacement_char_count, {_STRIPPED} = '' as blank
  from (select doc_id, source, coalesce(text, '') as text from documents)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("raw_text"))


@query(f"""
with c as ({_COUNTS})
select doc_id, total_char_count, nonspace_char_count, word_count, line_count, replacement_char_count, blank as blank_extraction,
  not blank and nonspace_char_count < 50 as near_blank_extraction, blank or nonspace_char_count < 50 or replacement_char_count > 0 as requires_manual_review,
  case when blank then 'blank_extraction' when nonspace_char_count < 50 then 'near_blank_extraction' when replacement_char_count > 0 then 'replacement_character' else 'none' end as review_reason_code
from c""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.assess_pages(_pages(spark, sf_dir))
    return out.select("doc_id", "total_char_count", "nonspace_char_count", "word_count", "line_count", "replacement_char_count", "blank_extraction", "near_blank_extraction", "requires_manual_review", "review_reason_code")


@query(f"""
with c as ({_COUNTS}), r as (
  select *, case when blank then 'blank_extraction' when nonspace_char_count < 50 then 'near_blank_extraction' when replacement_char_count > 0 then 'replacement_character' else 'none' end as code from c),
s as (select source, string_agg(code || ': ' || n, '; ' order by code) as review_reasons from (select source, code, count(*) as n from r where code <> 'none' group by all) group by source)
select r.source, count(*) as page_count, count(*) filter (blank) as blank_pages, count(*) filter (not blank and nonspace_char_count < 50) as near_blank_pages,
  count(*) filter (code <> 'none') as review_pages, min(nonspace_char_count) as min_nonspace, max(nonspace_char_count) as max_nonspace,
  round(avg(nonspace_char_count), 1) as mean_nonspace, any_value(s.review_reasons) as review_reasons,
  case when count(*) filter (code <> 'none') > 0 then 'Completed with warnings' else 'Completed' end as status
from r left join s using (source) group by r.source""")
def doc_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.document_quality(Q.assess_pages(_pages(spark, sf_dir)), key="source")
    return out.select("source", "page_count", "blank_pages", "near_blank_pages", "review_pages", F.col("min_nonspace").cast("long").alias("min_nonspace"), F.col("max_nonspace").cast("long").alias("max_nonspace"), F.round("mean_nonspace", 1).alias("mean_nonspace"), "review_reasons", "status")


@query(rf"""
select source, count(*) as page_count, count(*) filter (length({_STRIPPED}) >= 50) as extracted_pages,
  case when count(*) filter (length({_STRIPPED}) >= 50) = count(*) then 'Searchable PDF' when count(*) filter (length({_STRIPPED}) >= 50) = 0 then 'Scanned PDF' else 'Mixed PDF' end as original_file_format
from documents group by source""")
def document_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.inspect_documents(_pages(spark, sf_dir), key="source").drop("document_status")


@query("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.coalesce("text", F.lit(""))).alias("sha256"))


@query("select page_id, regexp_replace(html, '<[^>\\n]+>', '', 'g') as text from pages")
def html_tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.remove_html_tags("html").alias("text"))


@query()
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(html_unescape("html")).cast("long").alias("n_chars"))


@query("select doc_id, nfc_normalize(text) as text, nfc_normalize(text) = text as unchanged from documents")
def unicode_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = nfc("text")
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("text"), (made == F.col("text")).alias("unchanged"))


@query("select doc_id, strip_accents(text) as text from documents")
def accent_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_accents("text").alias("text"))


@query("select doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) as matching_text from documents")
def matching_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matching_text(F.col("text")).alias("matching_text"))


@query("select doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\\s+', ' ', 'g')) as duplicate_key from documents")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace(F.lower(nfkc("text"))).alias("duplicate_key"))


@query("""
select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed,
  nullif(trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^\\s*[:.\\-–—]+\\s*', '')), '') as title,
  lower(trim(regexp_replace(lang, '\\s+', ' ', 'g'))) as category,
  coalesce(nullif(regexp_replace(regexp_replace(source, '[^\\p{L}\\p{M}\\p{N}_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'none') as id_part
from documents""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_whitespace("text").alias("squeezed"), X.clean_title_separator("text").alias("title"), X.normalize_category("lang").alias("category"), X.safe_id_part("source").alias("id_part"))


@query("""
select doc_id, case when f = lower(f) and f <> upper(f) then true else false end as starts_lower,
  case when f = upper(f) and f <> lower(f) then true else false end as starts_upper,
  regexp_matches(t, '[.?!]$') as terminal
from (select doc_id, nullif(regexp_extract(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]'), '') as f,
  regexp_replace(regexp_replace(regexp_replace(text, '\\s+$', ''), '["''»”’)\\]]+$', ''), '\\s+$', '') as t from documents)""")
def sentence_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.starts_with_lowercase("text").alias("starts_lower"), X.starts_with_uppercase("text").alias("starts_upper"), X.has_terminal_punctuation("text").alias("terminal"))



@query("""
select o_orderkey, 'Decreto' as document_type, cast(o_orderkey as varchar) as document_number, strftime(o_orderdate, '%Y-%m-%d') as publication_date,
  'Plan' as document_title, 'Única' as version_type, cast(o_custkey as varchar) as source_external_id, 'Decree' as document_class, printf('CL_MMA_DEC_%06d', o_orderkey) as document_id
from orders""")
def header_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the register made from orders, read back field by field."""
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    lit = lambda s: F.lit(s)
    page = F.concat(lit("Tipo Norma :Decreto "), F.col("o_orderkey"), lit("\nFecha Publicación :"), day, lit("\nTítulo :PLAN\nTipo Versión :Única De : "), day, lit("\nId Norma :"), F.col("o_custkey"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", page.alias("page"))
    fields = X.header_fields("page")
    kind, number, cls = X.document_type_parts(F.col("document_type_raw"))
    out = out.select("o_orderkey", *(c.alias(n) for n, c in fields.items()))
    return out.select(
        "o_orderkey", kind.alias("document_type"), number.alias("document_number"), X.parse_dd_mm_yyyy("publication_date_raw").alias("publication_date"), X.title_case("document_title_raw").alias("document_title"),
        X.version_type("version_type_raw").alias("version_type"), "source_external_id", cls.alias("document_class"), X.document_id("CL", "MMA", "DEC", F.col("o_orderkey")).alias("document_id"),
    )


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as generated from orders")
def generated_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "Dec"]))
    said = F.concat(F.lit("Biblioteca - documento generado el "), F.dayofmonth("o_orderdate"), F.lit("-"), F.get(names, F.month("o_orderdate") - 1), F.lit("-"), F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_generated_date(said).alias("generated"))


@query("""
select doc_id, cast(len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\\s*(p[áÁ]gina|page)\\s+\\d+\\s*$'))) as bigint) as removed,
  array_to_string(list_filter(l, lambda x: not regexp_matches(x, '(?i)^\\s*(p[áÁ]gina|page)\\s+\\d+\\s*$')), chr(10)) as text
from (select doc_id, string_split(text || chr(10) || 'Página 3' || chr(10) || 'end', chr(10)) as l from documents)""")
def technical_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("text"), F.lit("\nPágina 3\nend"))
    kept, removed = X.remove_technical_lines(said)
    return table(spark, sf_dir, "documents").select("doc_id", removed.cast("long").alias("removed"), kept.alias("text"))


_ODD = " ".join([*P.CHARACTER_SWAPS, *P.CHARACTER_DROPS, *P.CHARACTER_EXPANSIONS])
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_EXPANDED = reduce(lambda sql, kv: f"replace({sql}, {_quoted(kv[0])}, {_quoted(kv[1])})", P.CHARACTER_EXPANSIONS.items(), f"text || {_quoted(' ' + _ODD)}")
_SWAPPED = reduce(lambda sql, kv: f"replace({sql}, {_quoted(kv[0])}, {_quoted(kv[1])})", [*P.CHARACTER_SWAPS.items(), *((c, "") for c in P.CHARACTER_DROPS)], _EXPANDED)


@query(rf"""
select doc_id, {_SWAPPED} as text,
  regexp_replace(text || chr(10) || 'regula-' || chr(10) || 'ción', '([\p{{L}}\p{{M}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{M}}\p{{N}}_])', '\1\2', 'g') as repaired
from documents""")
def character_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.replace_characters(F.concat(F.col("text"), F.lit(" " + _ODD))).alias("text"), X.repair_hyphenation(F.concat(F.col("text"), F.lit("\nregula-\nción"))).alias("repaired"))


@query()
def page_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.normalize_pages(_pages(spark, sf_dir))
    return out.select("doc_id", "raw_char_count", "normalized_char_count", "matching_text_char_count", "removed_technical_lines_count", "replacement_char_count", "normalization_status", "normalized_text")


@query("""
select doc_id, cast(row_number() over (partition by doc_id order by i) as int) as line_no, trim(l[i], ' ' || chr(9) || chr(13)) as text
from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents)) where trim(l[i], ' ' || chr(9) || chr(13)) <> ''""")
def logical_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("normalized_text"))
    lines = logical_lines(pages, key="doc_id")
    return lines.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "piece_no")).alias("line_no"), "text")


@query("select conv_id, '<DOCUMENT>' || chr(10) || string_agg('<PAGE number=\"' || turn || '\">' || chr(10) || coalesce(text, '') || chr(10) || '</PAGE>', chr(10) order by turn) || chr(10) || '</DOCUMENT>' as marked_text from conversations group by conv_id")
def marked_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_number"), F.col("text").alias("raw_text"))
    return writers.marked_text(pages, key="conv_id")


@query("select cast(doc_id as varchar) as document_id, 1 as page_number, text as raw_text, 'table' as extraction_method from documents")
def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.pages_from_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as next_text from conversations")
def conversation_next_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", {"next_text": "text"}).select("conv_id", "turn", "text", "next_text")


@query(rf"""
with c as (select conv_id, turn, {_NONSPACE} as n, {_STRIPPED} = '' as blank, contains(text, chr(65533)) as bad from (select conv_id, turn, coalesce(text, '') as text from conversations))
select conv_id, string_agg(turn || ':' || case when blank then 'blank_extraction' when n < 50 then 'near_blank_extraction' when bad then 'replacement_character' else 'none' end, ' ' order by turn) as codes from c group by conv_id""")
def page_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessments written back into documents that nest their pages, shown as page:code."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("page_number"), F.coalesce("text", F.lit("")).alias("raw_text"))
    nested = turns.groupBy("conv_id").agg(F.collect_list(F.struct("page_number", "raw_text")).alias("pages"))
    out = Q.with_assessments(nested, Q.assess_pages(turns), "conv_id")
    return out.select("conv_id", F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page_number"].cast("string"), p["review_reason_code"])), " ").alias("codes"))
