"""License scan: fixed phrases, and an exact containment join of text blocks with templates.

A block is any line with the lines after it, up to a blank one, until these have as many words as
the longest template, so a notice wrapped over lines lies in one block. A template matches a block
that holds at least ``THRESHOLD`` of its distinct words. Template words are ordered by the
number of lines that hold them over the whole corpus, rarest first. With ``need`` words to share, a
matching block must hold one of the template's first ``size - need + 1`` words (prefix filter: only
these are filed in the index that a block's words are joined with), have ``need`` distinct words
itself (length filter), and a first shared word at place ``i`` leaves at most ``size - i`` to share
(positional filter). What passes is compared exactly.

Only DataFrame functions run. The texts are read twice and never shuffled; index and templates are
tables, which Spark broadcasts while they are below its threshold, and only blocks around a line
with a prefix word are expanded.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shared import Scratch
from .url_filter import _LOWER, _UPPER, _text_array, ascii_lower

#: (phrase, label): a label's phrase stands in consecutive words.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: (label, notice)
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
THRESHOLD = 0.8
#: Prefix words that are looked for by one regular expression over a line; of more, every line is a candidate.
MAX_GUARD = 5_000
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(text: Column) -> Column:
    """Words in order; an empty text has none."""
    return F.filter(F.split(text, _SEPARATOR), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """A template's or phrase's words by the rule for texts."""
    return [w for w in re.split(_SEPARATOR, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _span(templates: list) -> int:
    """Words after its first line from which on a block takes no more lines."""
    return max([1, *(len(plain_words(notice)) for _, notice in templates)])


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)


def _blocks(span: int, least: int) -> Column:
    """Template words of each block that holds a line of ``__at`` and ``least`` such words, from the
    lines' sizes and template words ``__lists``."""
    grown = lambda s, x: F.when(
        s["more"] & (x["n"] > 0), F.struct(F.concat(s["held"], x["words"]).alias("held"), (s["after"] + x["n"]).alias("after"), (s["last"] + 1).alias("last"), (s["after"] + x["n"] < span).alias("more"))
    ).otherwise(F.struct(s["held"].alias("held"), s["after"].alias("after"), s["last"].alias("last"), F.lit(False).alias("more")))
    first = lambda i, x: F.struct(x["words"].alias("held"), F.lit(0).alias("after"), i.alias("last"), (x["n"] > 0).alias("more"))
    starts = F.sequence(F.lit(0), F.size("__lists") - 1)
    # A block has a word a line at least, so ``span`` lines after the first at most.
    near = F.filter(starts, lambda i: F.exists(F.col("__at"), lambda p: (p >= i) & (p <= i + span)))
    blocks = F.transform(near, lambda i: F.struct(i.alias("i"), F.aggregate(F.slice(F.col("__lists"), i + 2, span), first(i, F.get(F.col("__lists"), i)), grown).alias("s")))
    held = F.filter(blocks, lambda b: F.exists(F.col("__at"), lambda p: (p >= b["i"]) & (p <= b["s"]["last"])))
    return F.array_distinct(F.filter(F.transform(held, lambda b: F.array_distinct(b["s"]["held"])), lambda w: F.size(w) >= least))


def license_scan(docs: DataFrame, keep: list[str] = ("doc_id",), text_col: str = "text", phrases: list = PHRASES, templates: list = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    ``score`` is 1 where a phrase stands, else the largest share of a template's words held by
    one block that reaches the threshold, else 0. Null text counts as empty: no words, empty
    labels, null places. Repeated rows give equal rows; an empty table gives none. Templates and
    phrases are cut into words like texts; one without a word matches nothing. ``keep`` may name
    any column but those that are added here; other columns don't matter.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    sets = [(label, found) for label, notice in templates if (found := list(dict.fromkeys(plain_words(notice))))]
    phrases = [(found, label) for phrase, label in phrases if (found := plain_words(phrase))]
    vocabulary, span = sorted({w for _, words in sets for w in words}), _span(templates)
    text = F.coalesce(F.col(text_col), F.lit(""))

    # Lines that hold each template word; one row a word at most comes back.
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    held = lines.select(F.explode(F.array_intersect(F.split(ascii_lower(F.col("line")), _SEPARATOR), _text_array(vocabulary))).alias("word"))
    count = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()} if vocabulary else {}
    index, known = [], []
    for k, (label, words) in enumerate(sets):
        ranked = sorted(words, key=lambda w: (count.get(w, 0), w))
        need = _need(len(ranked), threshold)
        index += [(w, k, place) for place, w in enumerate(ranked[: len(ranked) - need + 1])]
        known.append((k, label, ranked, need))
    index = spark.createDataFrame(index, "word string, template int, place int")
    least = min([n for *_, n in known], default=1)
    known = spark.createDataFrame(known, "template int, label string, ranked array<string>, need int")

    # A block can only match if one of its lines holds a prefix word.
    prefixes = sorted({r["word"] for r in index.collect()})  # made above on the driver
    some = "|".join(map(_quoted, prefixes))
    guard = rf"(?i)(?<!{_WORD})(?:{some})(?!{_WORD})" if len(prefixes) <= MAX_GUARD else ""
    guard = guard if prefixes else "(?!)"
    phrase_guard = "(?i)" + "|".join(_SEPARATOR.join(map(_quoted, p)) for p, _ in phrases) if phrases else "(?!)"

    base = docs.select(*(F.col(c).alias(f"k_{c}") for c in keep), text.alias("__text"))
    base = base.withColumns({
        "n_words": F.size(_words(F.col("__text"))).cast("long"),
        "__words": F.when(F.col("__text").rlike(phrase_guard), _words(ascii_lower(F.col("__text")))),
        "__lines": F.when(F.col("__text").rlike(guard), F.split("__text", "\n")),
    })
    base = base.withColumns({
        "__at": F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.rlike(F.get(F.col("__lines"), i), F.lit(guard))),
        "__lists": F.transform("__lines", lambda x: F.struct(F.size(_words(x)).alias("n"), F.array_intersect(F.split(ascii_lower(x), _SEPARATOR), _text_array(vocabulary)).alias("words"))),
    })
    base = base.withColumn("blocks", F.when(F.col("__lines").isNotNull(), _blocks(span, least)))

    def places(words: list[str]) -> Column:
        stands = lambda i: reduce(Column.__and__, [F.get(F.col("__words"), (i + k).cast("int")) == w for k, w in enumerate(words)])
        return F.when(F.size("__words") >= len(words), F.filter(F.sequence(F.lit(0).cast("long"), (F.size("__words") - len(words)).cast("long")), stands))

    found = {f"at_{k}": F.coalesce(places(p), F.array().cast("array<bigint>")) for k, (p, _) in enumerate(phrases)}
    base = base.withColumns(found) if found else base
    everywhere = F.concat(*map(F.col, found)) if found else F.array().cast("array<bigint>")
    labelled = F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, label) for k, (_, label) in enumerate(phrases))))) if found else F.array().cast("array<string>")
    base = base.select(*(f"k_{c}" for c in keep), "n_words", everywhere.alias("at"), labelled.alias("base"), "blocks")
    base = scratch.save(base.withColumn("row", F.monotonically_increasing_id()), "base")

    blocks = base.select("row", F.posexplode("blocks").alias("block", "words"))
    filed = blocks.select("row", "block", "words", F.explode("words").alias("word")).join(index, "word")
    met = filed.groupBy("row", "block", "template").agg(F.min("place").alias("place"), F.first("words").alias("words")).join(known, "template")
    # Words beside those of any template can't be shared, so they don't count for the length.
    fits = met.filter((F.size("words") >= F.col("need")) & (F.size("ranked") - F.col("place") >= F.col("need")))
    shared = fits.select("row", "label", "need", F.size(F.array_intersect("words", "ranked")).alias("shared"), F.size("ranked").alias("size")).filter("shared >= need")
    hits = shared.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("size")).alias("share"))
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return base.join(hits, "row", "left").select(
        *(F.col(f"k_{c}").alias(c) for c in keep),
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def scan_sql() -> str:
    """The same rows for DuckDB, with every template held against every block."""
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    words = lambda x: f"regexp_extract_all({low(x)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    at = []
    for phrase, label in PHRASES:
        parts = plain_words(phrase)
        test = " and ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        at.append(f"select id, '{label}' as label, i as place from (select id, w, unnest(range(len(w) - {len(parts) - 1})) as i from words) where {test}")
    sets = ", ".join(f"({k}, '{label}', {list(dict.fromkeys(plain_words(notice)))}, {_need(len(set(plain_words(notice))), THRESHOLD)})" for k, (label, notice) in enumerate(TEMPLATES))
    return f"""
with numbered as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
words as (select id, doc_id, {words('text')} as w from numbered),
places as ({' union all '.join(at)}),
base as (select id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list_distinct(list(label))) as found from places group by id),
templates(k, label, ts, need) as (values {sets}),
lines as (select id, ln, {words('lines[ln]')} as w from (select id, lines, unnest(range(1, len(lines) + 1)) as ln from (select id, string_split(text, chr(10)) as lines from numbered))),
placed as (
  select id, ln, w, sum(len(w)) over (partition by id order by ln) - len(w) as before, count(*) filter (len(w) = 0) over (partition by id order by ln) as para from lines),
blocks as (
  select a.id, a.ln, list_distinct(flatten(list(b.w))) as w
  from placed a join placed b on a.id = b.id and a.para = b.para and b.ln >= a.ln and b.before - a.before - len(a.w) < {_span(TEMPLATES)} where len(a.w) > 0 and len(b.w) > 0 group by a.id, a.ln),
hits as (
  select id, label, len(list_intersect(w, ts)) / cast(len(ts) as double) as share
  from blocks, templates where len(list_intersect(w, ts)) >= need),
own as (select id, list_distinct(list(label)) as found, max(share) as share from hits group by id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word,
  coalesce(array_to_string(b.found, ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(o.found, [])))), ','), '') as labels,
  case when b.n_base > 0 then 1.0::double else coalesce(o.share, 0.0) end as score
from words w left join base b using (id) left join own o using (id)"""
