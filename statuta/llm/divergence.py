"""Divergence audit of sources: how far each source's words lie from its language's and from the other sources'.

A first pass over the texts makes a count-min sketch of document frequencies by (language, term) in
every task; the sketches merge through a reduction tree. A cell never underestimates, so a term
with a cell below the least document frequency can't be kept: the second pass drops it in the task
that has read it, before anything is shuffled. What is left is counted exactly, terms that the sketch
let through wrongly go then, and pairs of sources meet on the terms that both hold. Terms that one or
none of the two holds are taken from histograms of counts, as their shares depend on the count alone.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch, mix
from .words import Words

_U = np.uint64
MIN_DOCS, TOP_TERMS, SHARE = 3, 200, 1_000_000_000
#: Rows of the sketch, and the power of two of cells in each: a bound on its size (a bit a cell is broadcast). Results never depend on it.
DEPTH, WIDTH_BITS = 3, 23
#: Counters of a task are handed on at so many entries; a bound on memory only.
HELD = 400_000
#: Sketches that one step of the merging tree takes, and that reach the driver at the end, about.
FAN_IN = 16
#: Longer texts are cut into words piece by piece.
_PIECE = 1 << 22
#: Bytes of terms, A-Z folded to a-z; all others part terms.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased, in lists."""
    raw = raw.translate(_FOLDED)
    low = 0
    while len(raw) - low > _PIECE:
        high = raw.find(b" ", low + _PIECE)
        if high < 0:
            break
        yield raw[low:high].split()
        low = high
    yield raw[low:].split()


def _cells(lang: bytes, found: list[bytes]) -> np.ndarray:
    """Cells of the terms of a language, one row a row of the sketch."""
    seed = _U(int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest()))
    own = mix(Words(pa.array(found, pa.binary()).cast(pa.string())).hashes(fold=False) ^ seed)
    return np.stack([(mix(own + _U(k + 1)) >> _U(64 - WIDTH_BITS)).astype(np.int64) for k in range(DEPTH)])


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, bytes]]:
    return zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in range(3)))


def _pack(table: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(table.tobytes())


def _unpack(raw: bytes, cap: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.min_scalar_type(cap)).reshape(DEPTH, -1)


def _sketched(cap: int):
    """Batches of (lang, source, text) -> the task's sketch of document frequencies, counted up to ``cap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, 1 << WIDTH_BITS), dtype=np.min_scalar_type(cap))
        held: dict[bytes, Counter] = defaultdict(Counter)
        size = 0

        def spill() -> None:
            for lang, docs in held.items():
                weights = np.fromiter(docs.values(), dtype=np.int64, count=len(docs))
                for row, cells in zip(table, _cells(lang, list(docs))):
                    at, place = np.unique(cells, return_inverse=True)
                    row[at] = np.minimum(row[at] + np.bincount(place, weights=weights).astype(np.int64), cap)
            held.clear()

        for batch in batches:
            for lang, _, text in _columns(batch):
                own: set[bytes] = set()
                for part in terms(text):
                    own.update(part)
                if own:
                    docs = held[lang]
                    size -= len(docs)
                    docs.update(own)
                    size += len(docs)
                if size >= HELD:
                    spill()
                    size = 0
        spill()
        yield pa.RecordBatch.from_arrays([pa.array([_pack(table)], pa.binary())], names=["sketch"])

    return run


def _merged(docs: DataFrame, cap: int) -> np.ndarray:
    """Bits of all cells that reach ``cap``, packed, a row a row of the sketch."""
    sketches = docs.mapInArrow(_sketched(cap), "sketch binary").rdd.map(lambda row: bytes(row[0]))

    def add(a, b):
        if a is None or b is None:
            return a or b
        x, y = _unpack(a, cap), _unpack(b, cap)
        return _pack(np.minimum(x, cap - np.minimum(y, cap)) + y)  # min(x + y, cap) without overflow

    depth = max(2, math.ceil(math.log(max(2, sketches.getNumPartitions()), FAN_IN)))
    whole = sketches.treeAggregate(None, add, add, depth)
    table = _unpack(whole, cap) if whole else np.zeros((DEPTH, 1 << WIDTH_BITS), dtype=np.uint8)
    return np.packbits(table >= cap, axis=1, bitorder="little")


def _survivors(sent: Broadcast):
    """Batches of (lang, source, text) -> lang, source, term, occurrences and documents, for terms that may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = sent.value
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def spill() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                found = list(times)
                keep = np.ones(len(found), dtype=bool)
                for row, cells in zip(bits, _cells(lang, found)):
                    keep &= (row[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
                found = [t for t, k in zip(found, keep.tolist()) if k]
                if found:
                    text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
                    columns = [text([lang] * len(found)), text([source] * len(found)), text(found), pa.array([times[t] for t in found], pa.int64()), pa.array([docs[t] for t in found], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in _columns(batch):
                times, docs = held[lang, source]
                size -= len(times)
                own: set[bytes] = set()
                for part in terms(text):
                    times.update(part)
                    own.update(part)
                docs.update(own)
                size += len(times)
                if size >= HELD:
                    yield from spill()
                    size = 0
        yield from spill()

    return run


def _share(count: str, whole: str, kept: str) -> str:
    """SQL: 1 + floor(SHARE * (count + 1) / (whole + kept)), exact for any long."""
    return f"1L + (cast({SHARE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({whole} + {kept} as decimal(20,0))"


def _excess(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for every occurring (lang, source) its distance to each
    other source of the language (part ``pair``) and its ``top_terms`` terms of the largest excess over
    the language (part ``term``).

    Null text, language and source are ''; a text without terms counts as a document and its group
    occurs. A repeated row is another document. A source alone in its language has no pair; a language
    without kept terms gives pairs of value 0. Ties of a value are ordered by the item's UTF-8 bytes.
    An empty table gives no row; other columns are ignored. Values fit a long for up to 1e9 kept terms.
    """
    spark = docs.sparkSession
    if not 1 <= min_docs < 2**31:
        raise ValueError("min_docs must be positive")
    scratch = Scratch(spark, "divergence")
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    sent = spark.sparkContext.broadcast(_merged(src, min_docs))  # DEPTH * 2**WIDTH_BITS bits
    found = src.mapInArrow(_survivors(sent), "lang string, source string, term string, n long, docs long")
    each = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # a row a source at most
    each = each.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("first"))
    kept = scratch.save(each.filter(F.col("docs") >= min_docs).drop("docs"), "kept")
    sent.destroy()

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("kept"))
    groups = src.groupBy("lang", "source").count().drop("count").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "lang_size", "kept"])
    groups = groups.withColumn("zero", F.when(F.col("kept") > 0, F.expr(_share("0L", "size", "kept"))))
    groups = scratch.save(groups, "groups")

    rated = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", F.expr(_share("n", "size", "kept")).alias("p"), F.expr(_share("lang_n", "lang_size", "kept")).alias("q"))
    rated = scratch.save(rated, "rated")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ("lang", "source", "part", "item", "value", "rank")
    over = rated.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_excess("p", "q")).alias("value"))
    best = ranked(over).filter(F.col("rank") <= top_terms).select(*columns)

    # Pairs: every kept term as if neither source held it, then what the terms of one and of both change.
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    apart = F.col("source") != F.col("item")
    counts = rated.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("times"))
    counts = scratch.save(counts, "counts")
    neither = groups.join(other, "lang").filter(apart).select("lang", "source", "item", F.expr(f"coalesce(kept * ({_excess('zero', 'other_zero')}), 0L)").alias("value"))
    one = counts.join(other, "lang").filter(apart)
    mine = one.groupBy("lang", "source", "item").agg(F.expr(f"sum(times * ({_excess('p', 'other_zero')} - {_excess('zero', 'other_zero')}))").alias("value"))
    theirs = one.groupBy("lang", "item", "source").agg(F.expr(f"sum(times * ({_excess('other_zero', 'p')} - {_excess('other_zero', 'zero')}))").alias("value")).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    a = rated.select("lang", "term", "source", "p", "zero")
    b = rated.select("lang", "term", *(F.col(c).alias(f"other_{c}") for c in ("source", "p", "zero")))
    change = lambda x, y: f"{_excess(f'{x}p', f'{y}p')} - {_excess(f'{x}p', f'{y}zero')} - {_excess(f'{x}zero', f'{y}p')} + {_excess(f'{x}zero', f'{y}zero')}"
    both = a.join(b, ["lang", "term"]).filter("source < other_source").groupBy("lang", "source", "other_source").agg(F.expr(f"sum({change('', 'other_')})").alias("there"), F.expr(f"sum({change('other_', '')})").alias("back"))
    both = both.select("lang", F.expr("inline(array(struct(source, other_source as item, there as value), struct(other_source as source, source as item, back as value)))"))
    pairs = neither.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ranked(pairs.withColumn("part", F.lit("pair"))).select(*columns).unionByName(best)


def divergence_sql() -> str:
    """The same rows for DuckDB, by plain counting and every term of every pair."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = lambda n, size: f"cast(1 + cast({SHARE} as hugeint) * ({n} + 1) // ({size} + kept) as bigint)"
    excess = lambda p, q: f"cast(cast({p} - {q} as hugeint) * ({p} - {q}) // {q} as bigint)"
    return rf"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as materialized (select lang, term, count(*) as lang_n from t group by lang, term having count(distinct row) >= {MIN_DOCS}),
c as materialized (select lang, source, term, count(*) as n from t join v using (lang, term) group by lang, source, term),
l as (select lang, count(*) as kept, sum(lang_n) as lang_size from v group by lang),
s as (select lang, source, sum(n) as size from c group by lang, source),
g as (select distinct lang, source from d),
w as materialized (select g.lang, g.source, coalesce(kept, 0) as kept, coalesce(lang_size, 0) as lang_size, coalesce(size, 0) as size from g left join l using (lang) left join s using (lang, source)),
p as materialized (select w.lang, w.source, v.term, c.n, {share("coalesce(c.n, 0)", "size")} as p, {share("v.lang_n", "lang_size")} as q from w join v using (lang) left join c on c.lang = w.lang and c.source = w.source and c.term = v.term),
f as (select a.lang, a.source, b.source as item, sum({excess("a.p", "b.p")}) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, term as item, {excess("p", "q")} as value from p where n > 0 and p > q),
r as (select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
      union all select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms)
select lang, source, part, item, value, cast(rank as integer) as rank from r where part = 'pair' or rank <= {TOP_TERMS}"""
