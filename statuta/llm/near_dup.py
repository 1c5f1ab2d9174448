"""MinHash near-duplicate groups over fast similarity sketches.

1. Each text becomes its set of five-word shingles and a sketch of ``t`` coordinates: in round
   ``i`` every element falls into one hashed bin with the value ``i + u``; a bin keeps its least
   value; rounds go on until every bin is full, and rounds ``t .. 2t-1`` put every element into
   bin ``i - t``, so all of them fill. Coordinates of two sketches agree with the probability of
   the sets' Jaccard similarity, with the concentration of independent coordinates, in
   ``O(t log t + n)`` expected time.
2. Bands of ``r`` coordinates give bucket keys. Band counts follow from ``miss``: the chance
   that a pair right at the threshold shares no bucket.
3. Equal sets are one class, whose least ``doc_id`` stands for it. Classes that share a bucket
   are compared on their full sets, so no link is false. A bucket isn't expanded into pairs:
   each member is held against the bucket's centre, components are formed, and only buckets
   that still hold several components are looked at again, with the member that has the fewest
   shingles for itself as their centre.
4. Classes in buckets that are still open meet in an exact join: with
   their shingles in order of frequency, rarest first, two sets at the threshold share one of
   the first ``n - ceil(threshold * n) + 1``. A near copy with more edits than that has only
   shingles of its own there and meets nobody, so large groups of texts that are alike but
   below the threshold are not expanded into pairs.

Texts are fetched again for the compared classes only, and no set of all documents is stored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .components import connected_components
from .shared import Scratch, free_name, mix
from .words import pieces, shingle_sets

_U = np.uint64
#: Chance to miss a pair whose similarity is exactly the threshold.
MISS = 1e-6


def banding(threshold_pct: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows a band) for a threshold in per cent."""
    rows = 6 if threshold_pct >= 85 else 5
    return math.ceil(math.log(miss) / math.log(1 - (threshold_pct / 100) ** rows)), rows


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(len(sets), t) coordinates of non-empty sets of 64-bit hashes."""
    n = len(sets)
    full = np.full((n, t), np.iinfo(np.uint64).max, dtype=_U)
    flat, open_ = full.reshape(-1), np.arange(n)
    for i in range(2 * t):
        if not len(open_):
            break
        sizes = np.fromiter((len(sets[k]) for k in open_), dtype=np.int64, count=len(open_))
        values = mix(np.concatenate([sets[k] for k in open_]) ^ mix(np.array([i + 1], dtype=_U) * _U(0x9E3779B97F4A7C15)))
        bins = (((values >> _U(32)) * _U(t)) >> _U(32)).astype(np.int64) if i < t else np.full(len(values), i - t)
        np.minimum.at(flat, np.repeat(open_, sizes) * t + bins, (values & _U(0xFFFFFFFF)) | _U(i << 32))
        open_ = open_[(full[open_] == np.iinfo(np.uint64).max).any(axis=1)]
    return full


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) bucket keys; the band's number is part of its key."""
    parts = sketch.reshape(len(sketch), bands, rows)
    keys = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (len(sketch), bands)).copy()
    for k in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def _described(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 256):
                sets = shingle_sets(part.column(2), size)
                some = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for k, row in zip(some, band_keys(sketches([sets[k] for k in some], bands * rows), bands, rows) if some else []):
                    keys[k] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "cls", "bands"],
                )

    return run


def _verified(threshold_pct: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 256):
                linked, last, held = [], None, None
                for k, (b, own) in enumerate(zip(part.column(1).to_pylist(), shingle_sets(part.column(2), size))):
                    if b != last:
                        last, held = b, shingle_sets(part.column(3).slice(k, 1), size)[0]
                    both = len(np.intersect1d(own, held, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= threshold_pct * (len(own) + len(held) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 256):
                sets = [x.view(np.int64) for x in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "tokens"])

    return run


def _led(open_: DataFrame, texts: DataFrame, scratch: Scratch, threshold_pct: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Shingles (cls, token, df) that several open classes share, and (cls, n, alone, prefix): the
    number of shingles a class has for itself and the length of its prefix."""
    some = open_.select("cls", "n").distinct()
    held = scratch.save(texts.join(some.select("cls"), "cls").mapInArrow(_shingles(size), "cls binary, tokens array<long>"), "open_sets")
    tokens = held.select("cls", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    common = scratch.save(tokens.join(shared, "token"), "open_tokens")
    counted = some.join(common.groupBy("cls").agg(F.count("*").alias("n_common")), "cls", "left")
    led = counted.select("cls", "n", (F.col("n") - F.coalesce("n_common", F.lit(0))).alias("alone"), F.expr(f"n - cast(ceil({int(threshold_pct)} * n / 100D - 1e-9) as long) + 1").alias("prefix"))
    return common, scratch.save(led, "led")


def _open_pairs(open_: DataFrame, common: DataFrame, led: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that prefix and position leave possible.

    Shingles of one class alone come first in the order and can't be shared.
    """
    t = int(threshold_pct)
    some = open_.select("cls", "comp").distinct().join(led.filter("alone < prefix"), "cls")
    ranked = common.join(some, "cls").withColumn("place", F.col("alone") + F.row_number().over(W.partitionBy("cls").orderBy("df", "token"))).filter("place <= prefix")
    one = ranked.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"))
    two = ranked.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"))
    possible = F.expr(f"a < b and ca <> cb and 100 * least(na, nb) >= {t} * greatest(na, nb) and {100 + t} * (1 + least(na - pa, nb - pb)) >= {t} * (na + nb)")
    return one.join(two, "token").filter(possible).select("a", "b").distinct()


def near_dup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = 80, size: int = 5, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least id reachable over links of ``100 * |A & B| >= threshold_pct *
    |A | B|``; ``kept`` tells whether it is the document's own. Null and empty texts and texts
    without a word have an empty set and are linked with nothing. A null id can name no group:
    such a row has a null component and is kept. Rows under one id are one document, so its texts
    are linked and each row with a word carries the same component; an empty text among them has
    its own id. Repeated rows give equal rows, an empty table none. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    bands, rows = banding(threshold_pct, miss)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = src.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    info = scratch.save(hashed.mapInArrow(_described(bands, rows, size), "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>"), "info")

    named = info.filter("cls is not null and doc_id is not null")
    classes = scratch.save(named.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = scratch.save(buckets.join(shared, "key"), "members")

    # Texts of the classes that share a bucket with another one, once each.
    wanted = members.select("cls").distinct().join(classes.select("cls", "rep"), "cls").select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
    texts = scratch.save(hashed.join(wanted, ["doc_id", "text_hash"]).groupBy("cls").agg(F.first("text").alias("text")), "texts")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        held = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        return scratch.save(held.select("a", "b", "text_a", "text_b").mapInArrow(_verified(threshold_pct, size), "a binary, b binary, linked boolean"), name)

    fits = F.expr(f"100 * least(na, nb) >= {int(threshold_pct)} * greatest(na, nb)")
    tested = roots = common = led = None
    for turn in ("first", "central", "rest"):
        if roots is None:
            open_ = members.withColumn("comp", F.col("cls"))
        else:
            # Buckets of one component are settled.
            labelled = members.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("comp"))
            mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
            open_ = scratch.save(labelled.join(mixed, "key"), f"open_{turn}")
        if turn == "central":
            common, led = _led(open_, texts, scratch, threshold_pct, size)
            open_ = open_.join(led.select("cls", "alone"), "cls")
        if turn == "rest":
            pairs = _open_pairs(open_, common, led, threshold_pct)
        else:
            # The original of a group of copies has the fewest shingles for itself.
            order = F.struct("cls") if turn == "first" else F.struct("alone", "cls")
            centre = open_.groupBy("key").agg(F.min_by(F.struct("cls", "n", "comp"), order).alias("c"))
            pairs = open_.join(centre, "key").filter("comp <> c.comp").select(F.col("cls").alias("a"), F.col("c.cls").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb")).filter(fits)
            if turn == "first":
                # One test a class is enough to join most groups.
                pairs = pairs.groupBy("a").agg(F.min("b").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done = verify(scratch.save(pairs, f"pairs_{turn}"), f"tested_{turn}")
        tested = done if tested is None else tested.union(done)
        links = done.filter("linked").select("a", "b")
        if roots is None or not links.isEmpty():
            known = links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = connected_components(known, scratch, f"cc_{turn}")

    # Texts under one id are one document.
    several = named.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("last")).filter("b <> last").select("doc_id", "b")
    same = scratch.save(named.join(several, "doc_id").filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct(), "same")
    if not same.isEmpty():
        roots = connected_components(same.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch, "cc_same")

    component = classes.select("cls", F.col("rep.doc_id").alias("least")).join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = component.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = component.join(least, "root").select("cls", "component_id")
    out = info.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, threshold_pct: int = 80) -> DataFrame:
    """``docs`` without the documents whose near-duplicate group holds a smaller id; columns stay.

    The least id of a group decides, so there are no ties. Rows with a null id, null and empty
    texts stay; repeated rows are one document and stay or go together; an empty table gives none.
    """
    gone = near_dup_groups(docs, threshold_pct=threshold_pct).filter("not kept").select("doc_id").distinct()
    name = free_name(docs.columns, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", name), docs["doc_id"] == F.col(name), "left_anti")
