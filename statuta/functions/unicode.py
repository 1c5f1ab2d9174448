"""Functions that need Python's Unicode tables or libraries, as Arrow batches."""

from __future__ import annotations

import html
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType

from .text import normalize_whitespace


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def without_marks(text: str) -> str:
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(without_marks, na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)


def matching_text(c: Column) -> Column:
    """Accent-free, lower-case, single-spaced."""
    return normalize_whitespace(F.lower(strip_accents(c)))


def duplicate_key_text(c: Column) -> Column:
    """NFKC, lower case, single spaces: what makes two texts the same."""
    return normalize_whitespace(F.lower(nfkc(c)))


