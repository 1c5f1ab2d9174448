"""Hierarchy of a legal document: logical lines to a tree of typed elements.

What a line says of itself is one cascade of patterns, in DataFrame functions. Lines are then
shuffled once and sorted once, by document; what stands open above them and which elements they make
is worked out over many documents at once, in arrays (``open_lines.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, digits

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import patterns as P, text as X
from ..session import bounded_methods
from .open_lines import ARTICLES, CODE, DIVISIONS, HEADINGS, ITEMS, LABELLED, VISUALS, made_elements
from .tree import whole_documents

# How the marks of a legal text look; group 1 is the label, group 2 what follows.
METADATA_FIELD = r"(?iuU)^\s*(Tipo\s+Norma|Fecha\s+Publicaci[oó]n|Fecha\s+Promulgaci[oó]n|Organismo|T[ií]tulo|Tipo\s+Versi[oó]n|Inicio\s+Vigencia|Id\s+Norma|URL)\s*:\s*(.*)$"
TITLE_LIKE = r"(?U)^[A-ZÁÉÍÓÚÜÑ0-9 ,.;:\-()°º/]{20,}$"
NOTE_OF_OBJECT = r"(?iuU)^\s*(?:PI\s*=|CI\s*=|\(\*+\)|\*+\)|Nota\s*:|Observaci[oó]n\b).+"
MARKS = {
    "decree_header": r"(?iuU)^\s*(?:N[úu]m\.?|N[°º]\.?)\s*\d+[.\-]?\s+.*$",
    "preamble": r"(?iuU)^\s*(Visto|Considerando|Decreto|Resuelvo)\s*:\s*()$",
    "chapter": r"(?iuU)^\s*((?:CAP[IÍ]TULO|T[IÍ]TULO)\s+[IVXLCDM0-9]+)\s*(.*)$",
    "section": r"(?iuU)^\s*(SECCI[OÓ]N\s+[IVXLCDM0-9]+)\s*(.*)$",
    "subsection": r"(?iuU)^\s*((?:SUBSECCI[OÓ]N|P[ÁA]RRAFO)\s+[IVXLCDM0-9]+)\s*(.*)$",
    "numbered_heading": r"(?iuU)^\s*([IVXLCDM]+\.\d+(?:\.\d+)*)\s+(.+)$",
    "lettered_heading": r"(?U)^\s*([A-Z])\.\s+(.+)$",
    "transitory_article": r"(?iuU)^\s*(Art[íi]culo\s+(?:[úu]nico\s+)?Transitorio|Art[íi]culo\s+(?:primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo)\s+transitorio)\s*[:.\-–—]?\s*(.*)$",
    "article": r"(?iuU)^\s*(Art[íi]culo\s+[0-9]+[A-Za-z°º]?)\s*(?:[:.\-–—]+\s*(.*)|$)",
    "table": rf"(?iuU)^\s*((?:Tabla|Cuadro)\s+{P.VISUAL_NUMBER})\s*[:.]\s*(.*)$",
    "graph": rf"(?iuU)^\s*(Gr[áa]fico\s+{P.VISUAL_NUMBER})\s*[:.]\s*(.*)$",
    "figure": rf"(?iuU)^\s*(Figura\s+{P.VISUAL_NUMBER})\s*[:.]\s*(.*)$",
    "annex": r"(?iuU)^\s*(Anexo(?:\s+[A-Za-z0-9IVXLCDM]+)?)\s*[:.]\s*(.*)$",
    "source_note": r"(?iuU)^\s*(Fuente)\s*:\s*(.*)$",
    "compound_item": r"(?U)^\s*([a-zA-Z]\.\d+)\)\s+(.+)$",
    "numbered_item": r"(?U)^\s*((?!(?:19|20)\d{2}[.)])[0-9]+)[.)]\s+(.+)$",
    "roman_item": r"(?U)^\s*(i{1,3}|iv|v|vi{0,3}|ix|x)[.)]\s+(.+)$",
    "lettered_item": r"(?U)^\s*([a-zA-Z])[.)]\s+(.+)$",
    "bullet_item": r"(?U)^\s*([-–—])\s+(.+)$",
    "signature_block": r"(?iuU)^\s*(?:An[oó]tese|T[oó]mese raz[oó]n|Publ[ií]quese|Comun[ií]quese|Reg[ií]strese)\b",
}
#: Letters that a mark can begin with; other marks begin with anything.
FIRST = {
    "decree_header": "n", "preamble": "vcdr", "chapter": "ct", "section": "s", "subsection": "sp", "transitory_article": "a", "article": "a", "table": "tc", "graph": "g", "figure": "f",
    "annex": "a", "source_note": "f", "numbered_heading": "ivxlcdm", "roman_item": "ivx", "signature_block": "atpcr",
    "lettered_heading": ascii_lowercase, "compound_item": ascii_lowercase, "lettered_item": ascii_lowercase, "numbered_item": digits, "bullet_item": "-",
}

SCHEMA = (
    "document_id string, element_id string, parent_id string, element_order int, nesting_level int, element_type string, label string, title string, "
    "page_start int, page_end int, element_text string, text_source string, content_status string, structure_confidence string, requires_manual_review int, "
    "review_reason_code string, review_reason_note string"
)
SCHEMA_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
ELEMENTS = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (f.split() for f in SCHEMA.split(", ")) if name not in ("text_source", "content_status")])
DOC = "document_id"
#: Order of a document's lines.
ORDER = ["page_number", "line_no", "piece_no"]
FLAGS = {"requires_manual_review": "boolean", "review_reason_code": "string", "review_reason_note": "string"}


def logical_lines(pages: DataFrame, text_col: str = "normalized_text", key: str = DOC) -> DataFrame:
    """(document_id, page_number, line_no, piece_no, text, flags): lines without blanks, with preamble
    marks inside a line (at its start, after . ; : or '; y') on lines of their own."""
    flags = [c for c in FLAGS if c in pages.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = pages.select(key, "page_number", *flags, F.posexplode(F.split(text, r"\R", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter("line <> ''")
    mark = r"(?iU)(^|[.;:]\s*|;\s+y\s*)\b((?:Visto|Considerando|Decreto|Resuelvo)\s*:)"
    # The cut is put in as a control character that the text can't hold on one line.
    cut = F.regexp_replace("line", mark, "$1\n$2\n")
    pieces = lines.select(key, "page_number", *flags, "line_no", F.posexplode(F.split(cut, r"\n")).alias("piece_no", "text"))
    return pieces.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).filter("text <> ''")


def _begins(letters: str) -> Column:
    """Whether the stripped text begins with one of the letters, large or small, or outside of ASCII: patterns fold more than ASCII."""
    code = F.ascii("text")
    return code.isin(*sorted({ord(x) for x in letters + letters.upper()})) | (code > 127)


def _pick(table: dict[str, str], kind: str) -> Column:
    return reduce(lambda rest, k: F.when(F.col(kind) == k, table[k]).otherwise(rest), table, F.lit(None).cast("string"))


def _among(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _told(lines: DataFrame) -> DataFrame:
    """What each line says of itself, whatever stands around it."""
    kind = reduce(lambda rest, k: F.when(_begins(FIRST[k]) & F.rlike("text", F.lit(MARKS[k])), k).otherwise(rest), reversed(MARKS), F.lit("rest"))
    field = lambda k: F.when(_begins("tfoiu"), F.nullif(F.regexp_extract("text", METADATA_FIELD, k), F.lit("")))
    out = lines.withColumns({
        "kind": kind, "raw": field(1), "note": _begins("pc(*no") & F.rlike("text", F.lit(NOTE_OF_OBJECT)), "title_like": F.rlike("text", F.lit(TITLE_LIKE)),
    })
    names = [k for k in MARKS if k in LABELLED or k in ITEMS and k != "bullet_item"]
    first = reduce(lambda rest, k: rest.when(_among(k), F.regexp_extract("text", MARKS[k], 1)), names, F.when(_among("bullet_item"), "-").when(_among("source_note"), "Fuente"))
    second = [k for k in MARKS if k not in ("decree_header", "signature_block")]
    after = reduce(lambda rest, k: F.when(_among(k), F.regexp_extract("text", MARKS[k], 2)).otherwise(rest), second, F.lit(None).cast("string"))
    # Every view of a line is made once, in a column of its own.
    out = out.withColumns({"label": F.when(~_among("rest"), X.clean_small_text(first)), "after": F.when(~_among("rest"), after)})
    out = out.withColumns({"value": F.when(~_among(*ITEMS, "rest"), X.clean_title_separator("after")), "part": F.when(F.col("label").isNotNull(), F.nullif(X.safe_id_part("label", ""), F.lit("")))})
    visual = _among(*VISUALS, "annex")
    parts = [(_among(*HEADINGS), X.split_title("value", 10, cleaned=True)), (visual, X.split_visual_title("value", cleaned=True)), (_among("source_note"), X.split_title("value", 15, cleaned=True))]
    title, body = (reduce(lambda rest, part: F.when(part[0], part[1][k]).otherwise(rest), parts, F.when(_among(*(DIVISIONS if k == 0 else ARTICLES)), F.col("value"))) for k in (0, 1))
    out = out.withColumns({"title": title, "body": body})
    caption = F.when(F.col("label").isNotNull() & F.col("title").isNotNull(), F.concat("label", F.lit(": "), "title")).otherwise(F.col("text"))
    quoted = F.coalesce(F.concat(F.lit("Fuente: "), "title"), "text")
    said = F.when(_among(*DIVISIONS, *HEADINGS, *ARTICLES, "preamble"), F.lit(None).cast("string")).when(visual, caption).when(_among("source_note"), quoted).when(_among(*ITEMS), F.col("after")).otherwise(F.col("text"))
    some, plain = F.col("raw").isNotNull(), _among("rest")
    code = reduce(lambda rest, k: F.when(_among(k), CODE[k]).otherwise(rest), MARKS, F.lit(CODE["rest"]))
    base = F.concat_ws("_", DOC, _pick(LABELLED, "kind"), F.when(_among("preamble"), F.upper("part")).otherwise(F.col("part")))
    return out.select(
        *lines.columns, code.alias("said"), some.alias("is_field"), F.lower("raw").isin("título", "titulo").alias("is_title_field"), "note", "title_like",
        (plain & X.starts_with_lowercase("text")).alias("lower"), F.when(_among("numbered_heading"), F.size(F.split(F.regexp_extract("text", MARKS["numbered_heading"], 1), r"\."))).alias("level"),
        "label", "part", "title", "body", F.when(visual, X.is_visual_note("body")).alias("noted"), F.when(~plain, X.python_strip(said)).alias("content"), F.when(_among(*LABELLED), base).alias("base"),
        F.when(some, X.clean_small_text("raw")).alias("field_label"), F.when(F.col("title_like"), X.clean_small_text("text")).alias("small"),
        F.when(some, X.python_strip(F.concat(X.python_strip("raw"), F.lit(" :"), F.regexp_extract("text", METADATA_FIELD, 2)))).alias("field_text"),
    )


def parse_structure(pages: DataFrame, text_col: str = "normalized_text") -> DataFrame:
    """Flat tree, one row an element, of pages (document_id, page_number, normalized_text[, review flags]).

    A null text has no line; a document without lines has no element. Pages of a document are read
    in the order of their numbers. Blank review codes and notes count as null.
    """
    # Whole pages are dealt, so that lines are made and read in as many tasks; their number is given, as pages pack so well that Spark would put them together again.
    spark = pages.sparkSession
    bounded_methods(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lines = logical_lines(pages.withColumn(DOC, F.col(DOC).cast("string")).repartition(tasks, DOC), text_col)
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if FLAGS[c] == "string" else F.col(c)
    given = [(blank(c) if c in lines.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FLAGS.items()]
    lines = lines.select(DOC, F.col("page_number").cast("int").alias("page_number"), "line_no", "piece_no", "text", *given)
    lines = _told(lines).sortWithinPartitions(DOC, *ORDER).drop("line_no", "piece_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return whole_documents(batches, lambda table: made_elements(table, ELEMENTS))

    made = lines.mapInArrow(run, from_arrow_schema(ELEMENTS))
    has_text = F.col("element_text").isNotNull()
    status = F.when(has_text & F.col("element_type").isin(*VISUALS), "title_or_caption_extracted").when(has_text, "text_extracted")
    return made.withColumns({"text_source": F.when(has_text, "normalization.normalized_text"), "content_status": status}).select(*SCHEMA_NAMES)


def structure_counts(elements: DataFrame, key: str = DOC) -> DataFrame:
    conf = lambda x: F.count_if(F.col("structure_confidence") == x)
    return elements.groupBy(key).agg(F.count("*").alias("elements"), conf("high").alias("high"), conf("medium").alias("medium"), conf("uncertain").alias("uncertain"), F.count_if(F.col("requires_manual_review") == 1).alias("review"))
