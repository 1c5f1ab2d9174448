"""Text functions, Column in and Column out; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import patterns as P

SPACES = r"(?U)\s+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def python_strip(c: Column | str) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space become one space, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACES, " "))


def clean_small_text(c: Column | str) -> Column:
    """As above; empty becomes null."""
    return F.nullif(normalize_whitespace(c), F.lit(""))


normalize_marker_label = clean_small_text


def clean_title_separator(c: Column | str) -> Column:
    """A leading run of separators goes; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(normalize_whitespace(c), r"^\s*[:.\-–—]+\s*", "")), F.lit(""))


def parse_dd_mm_yyyy(c: Column | str) -> Column:
    """First dd-mm-yyyy in the text as yyyy-mm-dd, not checked against the calendar; else null."""
    part = lambda k: F.regexp_extract(_col(c), r"(?s)(\d{2})-(\d{2})-(\d{4})", k)
    return F.when(part(1) != "", F.concat_ws("-", part(3), part(2), part(1)))


def parse_generated_date(c: Column | str, english: bool = True) -> Column:
    """The repository's 'documento generado el d-Mon-yyyy' as ISO; ``english`` takes all English months, not May alone."""
    part = lambda k: F.regexp_extract(_col(c), r"(?iuU)documento generado el\s+(\d{1,2})-([A-Za-zÁÉÍÓÚáéíóúñÑ]+)-(\d{4})", k)
    months = F.create_map(*(F.lit(x) for kv in P.MONTHS.items() for x in kv))
    short = P.ENGLISH_MONTHS if english else {"may": "05"}
    month = F.coalesce(F.try_element_at(months, F.lower(part(2))), F.try_element_at(F.create_map(*(F.lit(x) for kv in short.items() for x in kv)), F.substring(F.lower(part(2)), 1, 3)))
    return F.when((part(1) != "") & month.isNotNull(), F.concat_ws("-", part(3), month, F.lpad(part(1), 2, "0")))


def header_fields(c: Column | str, whole_rest: bool = False) -> dict[str, Column]:
    """Raw header values by name. A value ends with its line, a title before the version line;
    ``whole_rest`` lets every value but the title run to the end of the text."""
    out = {}
    for name, label in P.HEADER_FIELDS.items():
        rest = r"(.+?)(?=\n\s*Tipo Versi[óo]n\s*:)" if name == "document_title_raw" else r"(.+)" if whole_rest else r"([^\n]+)"
        found = F.regexp_extract(_col(c), rf"(?isuU){label}\s*:\s*{rest}", 1)
        out[name] = F.when(F.regexp_like(_col(c), F.lit(rf"(?isuU){label}\s*:\s*{rest}")), normalize_whitespace(found))
    return out


def document_type_parts(c: Column | str) -> tuple[Column, Column, Column]:
    """(type, number, class) of 'Decreto 31': the class is Decree, the type itself or Other."""
    found = r"^([A-Za-zÁÉÍÓÚáéíóúñÑ]+)\s+(.+)"
    both = F.coalesce(F.regexp_like(_col(c), F.lit(found)), F.lit(False))
    kind = F.when(both, F.regexp_extract(_col(c), found, 1)).otherwise(_col(c))
    number = F.when(both, F.regexp_extract(_col(c), found, 2))
    return kind, number, F.when(F.lower(kind).startswith("decreto"), "Decree").otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("Other")))


def title_case(c: Column | str) -> Column:
    """Every run of letters starts upper and goes on lower, as in the corpus; two words stay small."""
    parts = F.regexp_extract_all(normalize_whitespace(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")
    return F.replace(F.replace(cased, F.lit("Atmosférica Para"), F.lit("Atmosférica para")), F.lit("La Región"), F.lit("la Región"))


def version_type(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(_col(c), " De :", 2), 1))


def document_id(country: str, institution: str, kind: str, number: Column) -> Column:
    return F.format_string(f"{country}_{institution}_{kind}_%06d", number)


def char_count(c: Column | str) -> Column:
    return F.length(F.coalesce(_col(c), F.lit("")))


def nonspace_char_count(c: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(_col(c), F.lit("")), SPACES, ""))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)\b\w+\b"))


def line_count(c: Column | str) -> Column:
    """Lines; a line break at the end adds none."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\R$", ""), r"\R", -1)))


def replacement_char_count(c: Column | str, doubled: bool = False) -> Column:
    """U+FFFD in the text; ``doubled`` counts each twice, as older reports did."""
    text = F.coalesce(_col(c), F.lit(""))
    n = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return n * 2 if doubled else n


def replace_characters(c: Column | str) -> Column:
    """Ligatures, spaces, zero-width characters, quotes, dashes and the ellipsis in plain form."""
    out = F.translate(_col(c), "".join(P.CHARACTER_SWAPS) + P.CHARACTER_DROPS, "".join(P.CHARACTER_SWAPS.values()))
    for old, new in P.CHARACTER_EXPANSIONS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def remove_html_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"<[^>\n]+>", "")


def lines_of(c: Column | str) -> Column:
    """The text's lines; none of an empty text, none after a break at the end."""
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\R$", ""), r"\R", -1))


def is_technical_line(line: Column) -> Column:
    return F.rlike(line, F.lit(P.TECHNICAL_LINE))


def remove_technical_lines(c: Column | str) -> tuple[Column, Column]:
    """(text without repository lines, number of lines removed)."""
    lines = lines_of(c)
    kept = F.filter(lines, lambda x: ~is_technical_line(x))
    return F.array_join(kept, "\n"), F.size(lines) - F.size(kept)


def repair_hyphenation(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")


def is_structural_marker(line: Column) -> Column:
    return F.rlike(line, F.lit(P.STRUCTURAL_MARKER))


def is_metadata_line(line: Column) -> Column:
    return F.rlike(line, F.lit(P.METADATA_LINE))


def is_continuable_marker(line: Column) -> Column:
    return F.rlike(line, F.lit(P.CONTINUABLE_MARKER))


def has_clear_sentence_end(line: Column) -> Column:
    return F.rlike(python_strip(F.regexp_replace(python_strip(line), r"[\"']+$", "")), F.lit(r"[.?!][)\]]?$"))


def split_title(c: Column | str, least: int = 10, cleaned: bool = False) -> tuple[Column, Column]:
    """(title, body): cut before the first capitalised function word after ``least`` characters of
    title; ``cleaned``: the separator is gone already."""
    value = _col(c) if cleaned else clean_title_separator(c)
    found = rf"(?U)^(.{{{least},}}?)\s+({P.TITLE_BREAK}.*)$"
    cut = F.coalesce(F.rlike(value, F.lit(found)), F.lit(False))
    return F.when(cut, F.regexp_extract(value, found, 1)).otherwise(value), F.when(cut, F.regexp_extract(value, found, 2))


def split_visual_title(c: Column | str, cleaned: bool = False) -> tuple[Column, Column]:
    """Notes and legends cut first, from 8 characters of title on; then as above from 12."""
    value = _col(c) if cleaned else clean_title_separator(c)
    found = rf"(?iU)^(.*?)\s+({P.VISUAL_NOTE}.*)$"
    noted = F.coalesce(F.rlike(value, F.lit(found)), F.lit(False)) & (F.length(F.regexp_extract(value, found, 1)) >= 8)
    title, body = split_title(value, 12, cleaned=True)
    return F.when(noted, F.regexp_extract(value, found, 1)).otherwise(title), F.when(noted, F.regexp_extract(value, found, 2)).otherwise(body)


def is_visual_note(c: Column | str) -> Column:
    return F.coalesce(F.rlike(_col(c), F.lit(rf"(?iU)^\s*{P.VISUAL_NOTE}")), F.lit(False))


def split_source_note(c: Column | str) -> tuple[Column, Column]:
    found = r"(?iU)^\s*Fuente\s*:\s*(.*)$"
    title, body = split_title(F.regexp_extract(_col(c), found, 1), 15)
    is_note = F.rlike(_col(c), F.lit(found))
    return F.when(is_note & title.isNotNull(), F.concat(F.lit("Fuente: "), title)).otherwise(_col(c)), F.when(is_note, body)


def first_letter(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), f"[{P.LETTERS}]", 0), F.lit(""))


def starts_with_lowercase(c: Column | str) -> Column:
    x = first_letter(c)
    return F.coalesce((x == F.lower(x)) & (x != F.upper(x)), F.lit(False))


def starts_with_uppercase(c: Column | str) -> Column:
    x = first_letter(c)
    return F.coalesce((x == F.upper(x)) & (x != F.lower(x)), F.lit(False))


def safe_id_part(c: Column | str, fallback: Column | str = "none") -> Column:
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    made = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(_col(c), F.lit("")), other), r"(?U)\W+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), other)


def strip_closing_punctuation(c: Column | str) -> Column:
    ends = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    return ends(F.regexp_replace(ends(_col(c)), r"""["'»”’)\]]+$""", ""))


def has_terminal_punctuation(c: Column | str) -> Column:
    return F.rlike(strip_closing_punctuation(c), F.lit(r"[.?!]$"))


def trim_span(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Offsets (0-based, half open) without white space at the ends of the span."""
    span = F.substring(text, start + 1, end - start)
    lead = F.length(F.regexp_extract(span, r"(?U)^\s*", 0))
    tail = F.length(F.regexp_extract(span, r"(?U)\s*$", 0))
    low = F.least(start + lead, end)
    return low, F.greatest(low, end - tail)


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | (python_strip(_col(c).cast("string")) == "")


def normalize_category(c: Column | str) -> Column:
    return F.lower(normalize_whitespace(c))


def comparison_value(c: Column, kind: str) -> Column:
    """Canonical text: blank is empty, whole floats are integers, others have 12 significant digits."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        digits = F.regexp_replace(F.regexp_replace(F.format_string("%.12g", c), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
        return F.when(c.isNull() | F.isnan(c), "").when(whole, c.cast("long").cast("string")).otherwise(digits)
    text = python_strip(c.cast("string"))
    return F.coalesce(text, F.lit(""))


def duplicate_group_id(normalised: Column) -> Column:
    return F.concat(F.lit("DUP_"), F.upper(F.substring(F.sha2(normalised, 256), 1, 16)))


def stable_json(**fields: Column) -> Column:
    """JSON text with keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def relative_path(c: Column, root: str) -> Column:
    """A path below ``root`` without it; another as it is."""
    base = root.rstrip("/") + "/"
    return F.when(c.startswith(base), F.substr(c, F.lit(len(base) + 1))).otherwise(c)


def resolve_path(c: Column, root: str) -> Column:
    """A relative path below ``root``; an absolute one, or one with a scheme, as it is."""
    return F.when(F.rlike(c, F.lit(r"^(?:/|[A-Za-z][A-Za-z0-9+.\-]*:)")), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(c, r"^(?:\./)+", "")))


def seeded_digest(seed: int, c: Column) -> Column:
    """Hex digest whose order is the seeded pseudo-random order of a key."""
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), c.cast("string")), 256)


def fingerprint(content: Column | str) -> Column:
    """SHA-256 of bytes or of a text's UTF-8, as lower-case hex."""
    return F.sha2(content, 256)
