"""Page normalization: characters, tags, repository lines, hyphenation, line re-flow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P, text as X
from ..functions.unicode import html_unescape, matching_text, nfc

# Fixed value: the warning of the output.
WARNING = "Replacement character detected in raw_text; it was flagged but not automatically corrected."


class Flow:
    """Lines joined where a sentence was only wrapped: markers, metadata and lines after a closing
    mark begin anew, captions and headings go on until a sentence ends, all else is one sentence
    with the line before. Each text is read once, whatever its length."""

    def __init__(self):
        self.own = [P.compiled(x) for x in (P.STRUCTURAL_MARKER, P.METADATA_LINE)]
        self.goes_on, self.article, self.mark = P.compiled(P.CONTINUABLE_MARKER), P.compiled(P.ARTICLE_ONLY), P.compiled(P.TERMINAL_MARKS)
        self.ended, self.article_mark = P.compiled(r"[.?!][)\]]?$"), P.compiled(r":|-|\.-")
        self.blanks, self.gap, self.before_mark = P.compiled(r"[ \t]+"), P.compiled(r"\n{3,}"), P.compiled(r"\s+([:;,.])")

    def sentence_ended(self, pieces: list[str]) -> bool:
        for k in range(len(pieces) - 1, -1, -1):
            # Quotes at the end don't count; a piece of quotes alone shows the one before.
            if bare := pieces[k].rstrip("\"'").rstrip():
                return bool(self.ended.search(bare))
        return False

    def joins(self, pieces: list[str], line: str) -> bool:
        """Whether ``line`` goes on with the line that ``pieces`` make."""
        if any(x.search(line) for x in self.own):
            return False
        whole = pieces[0] if len(pieces) == 1 else " ".join(pieces[:3])
        if self.goes_on.search(whole) and not self.sentence_ended(pieces):
            return True
        if len(pieces) == 1 and self.article.search(whole) and self.article_mark.match(line):
            return True
        return not self.mark.search(pieces[-1])

    def text(self, text: str | None) -> str | None:
        if text is None:
            return None
        out: list[list[str]] = []
        for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            line = self.blanks.sub(" ", line).strip()
            if out and out[-1] and line and self.joins(out[-1], line):
                out[-1].append(line)
            elif line or (out and out[-1]):
                out.append([line] if line else [])
        made = self.blanks.sub(" ", "\n".join(" ".join(x) for x in out))
        return self.before_mark.sub(r"\1", self.gap.sub("\n\n", made)).strip()


@F.pandas_udf(StringType())
def reflow(texts: pd.Series) -> pd.Series:
    return texts.map(Flow().text, na_action="ignore")


def normalize_pages(pages: DataFrame, text_col: str = "raw_text", ref_compat: bool = False) -> DataFrame:
    """``pages`` with normalized_text, matching_text and counts; the raw text stays as it is."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    cleaned = X.remove_html_tags(X.replace_characters(nfc(html_unescape(raw))))
    step = pages.withColumn("__clean", cleaned)
    kept, removed = X.remove_technical_lines("__clean")
    step = step.withColumn("removed_technical_lines_count", removed.cast("long")).withColumn("normalized_text", reflow(X.repair_hyphenation(kept)))
    step = step.withColumn("matching_text", matching_text(F.col("normalized_text")))
    replaced = X.replacement_char_count(raw, ref_compat).cast("long")
    return step.drop("__clean").withColumns({
        "raw_char_count": F.length(raw).cast("long"),
        "normalized_char_count": F.length("normalized_text").cast("long"),
        "matching_text_char_count": F.length("matching_text").cast("long"),
        "replacement_char_count": replaced,
        "normalization_status": F.when(replaced > 0, "completed_with_warnings").otherwise("completed"),
        "normalization_warning": F.when(replaced > 0, WARNING),
    })
