"""Line dedup by a fixed-depth template tree.

A line's path in the tree is its token count and its ``DEPTH`` leading tokens; tokens with a digit
are variable fields ``<*>``, unless they are more than half of the line. The rest of a line is cut
into ``PARTS`` parts (single tokens in short lines), and a leaf generalises lines by similarity:
two lines share a template if they agree on every part but at most ``OPEN`` of them, wherever these
lie (one in lines of fewer than five tokens). The open parts are the template's variable fields.

Templates are counted by the documents that hold them. A line that stands in ``MIN_DOCS`` documents
as it is, or matches a generalised template in ``OPEN_DOCS``, is dropped from every document but the
template's first (the least id), so no content is lost as a whole.

Only 8-byte keys are shuffled and counted with partial sums, so a line that is in a third of all
documents costs a row a partition. Two lines that agree on three parts of five agree on one of four
pairs of parts; keys of those pairs pick the lines that can share a generalised template at all, and
only these make all their template keys. Texts move once, to meet their dropped line numbers. Tables
of keys and lines grow with the corpus, so they are never broadcast, at whatever size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch, free_name, meet, mix
from .words import Words, pieces

_U = np.uint64
DEPTH = 2
PARTS, OPEN = 5, 2
MIN_DOCS, OPEN_DOCS = 2, 3
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_FIELD = mix(np.array([42], dtype=_U))[0]
#: Pairs of five parts of which any three parts hold one.
_PAIRS = [(0, 1), (2, 3), (2, 4), (3, 4)]


def open_parts(n: int) -> tuple[int, int]:
    """(parts, open ones) of a line of ``n`` tokens."""
    parts = max(0, min(PARTS, n - DEPTH))
    return parts, min(parts, OPEN if n >= 5 else 1)


def line_parts(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves, hashes of the parts and numbers of parts of lines that follow each other in ``hashes``.

    A part is a sum of place-dependent hashes, so all are read off one running sum.
    """
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(starts, counts) + 1
    running = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(hashes + place.astype(_U) * _U(0x9E3779B97F4A7C15)), dtype=_U)])
    upto = lambda within: running[starts + within]
    lead = np.minimum(DEPTH, counts)
    leaf = mix(counts.astype(_U) * _U(0xD6E8FEB86659FD93) + upto(lead) - running[starts])
    parts = np.clip(counts - DEPTH, 0, PARTS)
    edges = [np.minimum(lead + (i * np.maximum(counts - DEPTH, 0)) // np.maximum(parts, 1), counts) for i in range(PARTS + 1)]
    sums = np.stack([upto(edges[i + 1]) - upto(edges[i]) for i in range(PARTS)], axis=1)
    return leaf.view(np.int64), mix(sums)[np.arange(PARTS) < parts[:, None]].view(np.int64), parts


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2):
            found = Words(part.column(2))
            if not len(found.starts):
                continue
            breaks = np.flatnonzero(found.data == 10)
            # A new line begins after every line feed and with every text.
            row = np.searchsorted(found.offsets, found.starts, side="right") - 1
            line = np.searchsorted(breaks, found.starts)
            cuts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 0))
            counts = np.diff(np.append(cuts, len(row)))
            number = line[cuts] - np.searchsorted(breaks, found.offsets[row[cuts]])
            field = found.per_word(_DIGIT[found.data]) > 0
            some = 2 * np.add.reduceat(field.astype(np.int64), cuts) <= counts
            hashes = found.hashes(fold=False)
            hashes[field & np.repeat(some, counts)] = _FIELD
            leaf, parts, sizes = line_parts(hashes, counts)
            at = pa.array(row[cuts])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(parts))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number, pa.int32()), pa.array(leaf), lists], names=["doc_id", "text_hash", "line", "leaf", "parts"])


def _keys(sizes: dict[int, list[tuple[int, ...]]]) -> F.Column:
    """Keys of a line: of its leaf with each listed set of parts, by its number of parts."""
    out = F.array().cast("array<long>")
    for n, sets in sizes.items():
        made = F.array(*(F.xxhash64("leaf", F.lit(" ".join(map(str, kept))), *(F.get("parts", F.lit(i)) for i in kept)) for kept in sets))
        out = F.when(F.size("parts") == n, made).otherwise(out)
    return out


#: number of parts -> sets of parts that a template keeps.
TEMPLATES = {parts: list(combinations(range(parts), parts - open_)) for parts, open_ in map(open_parts, range(DEPTH + 1, DEPTH + PARTS + 1))}


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, open_docs: int = OPEN_DOCS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; ``counts`` names two more columns for the lines before and dropped.

    Null texts stay null with no line; an empty text has one empty line; lines without a token
    always stay. A text that loses all its lines is empty, its row stays. A null id comes after
    every other id; rows that agree on id and text are the same document and keep or lose the
    same lines; of several texts under one id the one with the least hash comes first. An empty
    table gives none. Names of other columns don't matter.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = [c for c in docs.columns if c not in (counts or ())]
    hash_, id_, text_, gone_, parts_ = (free_name(own, x) for x in ("line_hash", "line_id", "line_text", "line_gone", "line_parts"))
    keyed = docs.select(*own, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias(id_), F.xxhash64(F.col(text_col)).alias(hash_))
    src = keyed.select(F.col(id_).alias("doc_id"), F.col(hash_).alias("text_hash"), F.col(text_col).alias("text"))
    lines = scratch.save(src.mapInArrow(_lines, "doc_id long, text_hash long, line int, leaf long, parts array<long>").withColumn("at", F.monotonically_increasing_id()), "lines")

    place = ["doc_id", "text_hash", "line"]

    def frequent(filed: DataFrame, least: int) -> DataFrame:
        """``filed`` with a key on so many lines."""
        return meet(filed, filed.groupBy("key").agg(F.count("*").alias("rows")).filter(f"rows >= {int(least)}").select("key"), ["key"])

    def met(filed: DataFrame, least: int, name: str) -> tuple[DataFrame, DataFrame]:
        """(key, place) of the keys in at least so many documents, and the keys with their first document."""
        # Most keys stand alone; documents are looked at for the rest only.
        places = scratch.save(frequent(filed, least), f"places_{name}")
        spread = places.select("key", "doc_id", "text_hash").distinct().groupBy("key").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
        return places, spread.filter(f"docs >= {int(least)}").select("key", F.col("first.doc_id").alias("f_id"), F.col("first.text_hash").alias("f_hash"))

    paired = lines.select("at", F.explode(_keys(TEMPLATES | {PARTS: _PAIRS})).alias("key"))
    opened = meet(lines, frequent(paired, open_docs).select("at").distinct(), ["at"]).select(*place, F.explode(_keys(TEMPLATES)).alias("key"))
    dropped = None
    for name, filed, least in (("whole", lines.select(*place, F.xxhash64("leaf", "parts").alias("key")), min_docs), ("open", opened, open_docs)):
        places, spread = met(filed, least, name)
        some = meet(places, spread, ["key"]).filter("doc_id <> f_id or text_hash <> f_hash").select(*place)
        dropped = some if dropped is None else dropped.union(some)
    by_doc = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias(gone_))
    by_doc = by_doc.select(F.col("doc_id").alias(f"{id_}_2"), F.col("text_hash").alias(text_), gone_)
    out = keyed.join(by_doc.hint("merge"), (F.col(id_) == F.col(f"{id_}_2")) & (F.col(hash_) == F.col(text_)), "left").withColumn(parts_, F.split(F.col(text_col), "\n", -1))
    parts = F.col(parts_)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone_))
    text = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    more = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in zip((parts, F.col(gone_)), counts or ())]
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in own), *more)


def dedup_sql() -> str:
    """The same rows for DuckDB, with templates as token lists."""
    opened = []
    for parts in range(1, PARTS + 1):
        edge = lambda i, parts=parts: f"({DEPTH} + ({i} * (n - {DEPTH})) // {parts})"
        for n_open in {open_parts(n)[1] for n in range(DEPTH + 1, DEPTH + PARTS + 1) if open_parts(n)[0] == parts}:
            size = f"n >= {DEPTH + PARTS}" if parts == PARTS else f"n = {DEPTH + parts}"
            for out in combinations(range(parts), n_open):
                inside = " or ".join(f"(k > {edge(i)} and k <= {edge(i + 1)})" for i in out)
                opened.append(f"select id, line, list_transform(t, lambda x, k: case when {inside} then '<{out}>' else x end) as template, n from tokens where {size}")
    return f"""
with docs as (select row_number() over (order by coalesce(doc_id, 9223372036854775807), text) as id, * from documents),
lines as (select id, i - 1 as line, parts[i] as raw from (select id, parts, unnest(range(1, len(parts) + 1)) as i from (select id, string_split(text, chr(10)) as parts from docs))),
words as (select id, line, t, list_transform(t, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as masked, len(t) as n
  from (select id, line, regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+') as t from lines) where len(t) > 0),
tokens as (select id, line, n, case when 2 * len(list_filter(masked, lambda x: x = '<*>')) <= n then masked else t end as t from words),
whole as (select t as template, min(id) as first from tokens group by t having count(distinct id) >= {MIN_DOCS}),
filed as ({' union all '.join(opened)}),
open as (select template, min(id) as first from filed group by template having count(distinct id) >= {OPEN_DOCS}),
dropped as (
  select id, line from tokens t join whole w on t.t = w.template where t.id <> w.first
  union select id, line from filed f join open o using (template) where f.id <> o.first),
kept as (select l.id, string_agg(l.raw, chr(10) order by l.line) as text, count(*) as n from lines l anti join dropped d on l.id = d.id and l.line = d.line group by l.id),
total as (select id, count(*) as n_lines from lines group by id)
select d.doc_id, d.lang, d.source, case when d.text is null then null else coalesce(k.text, '') end as text,
  cast(length(coalesce(k.text, '')) as bigint) as n_chars, coalesce(t.n_lines, 0) as n_lines, coalesce(t.n_lines, 0) - coalesce(k.n, 0) as n_dropped
from docs d left join kept k using (id) left join total t using (id)"""
