"""Regular expressions and word lists of the legal-text domain, for Java's engine.

``(?U)`` makes ``\\s \\w \\b`` follow Unicode and ``(?iu)`` folds accented letters.
"""

import re

# Labels, word lists and markers that results depend on.
CLASSES = ["regulative", "constitutive", "non_institutional"]
MONTHS = {
    "enero": "01", "febrero": "02", "marzo": "03", "abril": "04", "mayo": "05", "junio": "06", "julio": "07",
    "agosto": "08", "septiembre": "09", "setiembre": "09", "octubre": "10", "noviembre": "11", "diciembre": "12",
}
ENGLISH_MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}
HEADER_FIELDS = {
    "document_type_raw": "Tipo Norma",
    "publication_date_raw": "Fecha Publicación",
    "promulgation_date_raw": "Fecha Promulgación",
    "issuing_institution": "Organismo",
    "document_title_raw": "Título",
    "version_type_raw": "Tipo Versión",
    "effective_date_raw": "Inicio Vigencia",
    "source_external_id": "Id Norma",
    "source_url_repository": "URL",
}
TECHNICAL_LINE = (
    r"(?iU)^\s*(Biblioteca del Congreso Nacional de Chile\s*-\s*www\.leychile\.cl\s*-\s*documento generado el\b.*|P[áÁ]gina\s+\d+\s*|Page\s+\d+\s*)$"
)
STRUCTURAL_MARKER = (
    r"(?U)^\s*(?:(?:CAP[IÍ]TULO|Cap[íi]tulo|T[IÍ]TULO|T[íi]tulo|SECCI[OÓ]N|Secci[oó]n|SUBSECCI[OÓ]N|Subsecci[oó]n|P[ÁA]RRAFO|P[áa]rrafo)\b"
    r"|(?:ART[IÍ]CULO|Art[íi]culo)\s+\d+[A-Za-z°º]?\s*(?=[:.\-–—]|$)"
    r"|[IVXLCDM]+\.\d+(?:\.\d+)*\b|[0-9]+[.)]\s+|[a-zA-Z]\)\s+|[ivxlcdm]+\)\s+"
    r"|(?:Tabla|TABLA|Gr[áa]fico|GR[ÁA]FICO|Figura|FIGURA|Anexo|ANEXO)\b|(?:Fuente|FUENTE):)"
)
METADATA_LINE = r"(?iU)^\s*(Tipo\s+Norma|Fecha\s+Publicaci[oóÓ]n|Fecha\s+Promulgaci[oóÓ]n|Organismo|T[iíÍ]tulo|Tipo\s+Versi[oóÓ]n|Inicio\s+Vigencia|Id\s+Norma|URL)\s*:"
CONTINUABLE_MARKER = r"(?iU)^\s*(CAP[IÍí]TULO\b|T[IÍí]TULO\b|SECCI[OÓó]N\b|SUBSECCI[OÓó]N\b|P[ÁAá]RRAFO\b|[IVXLCDM]+\.\d+(\.\d+)*\b|Tabla\b|Gr[áaÁ]fico\b|Figura\b|Anexo\b|Fuente:)"
ARTICLE_ONLY = r"(?iU)^\s*Art[íiÍ]culo\s+\d+\s*$"
TERMINAL_MARKS = r"""[.;:?!)\]}"']$"""
#: character -> what it becomes: spaces, double quotes, single quotes, dashes.
CHARACTER_SWAPS = {
    "\u00a0": " ", "\u2007": " ", "\u202f": " ",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"', "\u00ab": '"', "\u00bb": '"',
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u2014": "-", "\u2013": "-", "\u2212": "-", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2015": "-",
}
#: Zero-width characters and soft hyphens go.
CHARACTER_DROPS = "\u200b\u200c\u200d\ufeff\u00ad"
CHARACTER_EXPANSIONS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "…": "..."}
TITLE_BREAK_WORDS = [
    "El", "La", "Los", "Las", "Un", "Una", "Unos", "Unas", "Este", "Esta", "Estos", "Estas", "Dicho", "Dicha", "Dichos", "Dichas", "Al", "Del", "A",
    "Ante", "Bajo", "Cabe", "Con", "Contra", "De", "Desde", "Durante", "En", "Entre", "Hacia", "Hasta", "Mediante", "Para", "Por", "Según", "Sin",
    "So", "Sobre", "Tras", "Vía", "Que", "Si", "Aunque", "Cuando", "Mientras", "Como", "Donde", "Porque", "Pues", "Asimismo", "Además", "Se",
]
TITLE_BREAK_PHRASES = [r"No\s+obstante", r"Sin\s+embargo", r"Tal\s+como", r"Cabe\s+señalar"]
TITLE_BREAK = "(?:" + "|".join(TITLE_BREAK_WORDS + TITLE_BREAK_PHRASES) + r")\b"
VISUAL_NOTE = r"(?:PI\s*=|CI\s*=|\(\*+\)|Nota\s*:|Observaci[oóÓ]n\b|Fuente\s*:)"
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
VISUAL_NUMBER = r"(?:[IVXLCDM]+(?:[-\s]\d+(?:[-.]\d+)*)?|\d+(?:[-.]\d+)*)"
SEGMENTABLE = ["paragraph", "numbered_item", "lettered_item", "compound_item", "roman_item", "bullet_item"]
SENTENCE_WARNINGS = {
    "very_short_sentence": "Candidate has fewer than 20 characters or fewer than three word-like tokens.",
    "sentence_starts_lowercase": "The first alphabetic character is lowercase; inspect for an over-split continuation.",
    "possible_abbreviation_split": "An accepted boundary follows a known abbreviation and should be reviewed.",
    "missing_terminal_punctuation": "Candidate lacks final period, question mark, or exclamation mark; list items may be legitimate.",
}


def compiled(pattern: str) -> re.Pattern:
    """The same pattern for Python, whose classes follow Unicode anyway."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    ignore = re.IGNORECASE if flags and "i" in flags[1] else 0
    return re.compile(pattern[flags.end() :] if flags else pattern, ignore)
