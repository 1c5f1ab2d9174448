"""Order-constrained alignment of long documents over many tasks.

The programme's cost lies in the similarities of blocks. These are cut into tiles of the grid of
candidates and references, each a task of its own: the sets of words and of word pairs of all blocks
that end in a tile become rows of two matrices, whose products are all the intersections at once.
What reaches the limit goes on, as sparse cells. One pass over a document's tiles in order then runs
the programme row by row in arrays of whole numbers, so the blocks are those of the full programme.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .alignment import BLOCK_PENALTY, LEAST, MAX_CANDIDATES, MAX_REFERENCES, SKIP, UNIT, WEIGHTS, _whole

#: Candidates and references of a tile.
TILE = 32
SIDES = ((MAX_CANDIDATES, "candidates"), (MAX_REFERENCES, "references"))


def block_sets(keys: list[str], first: int, most: int) -> tuple[list[set], list[set], np.ndarray]:
    """Words, word pairs and lengths of the blocks of 1 to ``most`` keys that end at each key from ``first`` on; None for blocks that begin before the keys."""
    words, pairs, lengths = [], [], []
    split = [k.split() for k in keys]
    for size in range(1, most + 1):
        for end in range(first, len(keys)):
            if end - size + 1 < 0:
                words.append(set()), pairs.append(set()), lengths.append(-1)
                continue
            own = [w for part in split[end - size + 1 : end + 1] for w in part]
            words.append(set(own)), pairs.append(set(zip(own, own[1:])))
            lengths.append(sum(map(len, keys[end - size + 1 : end + 1])) + size - 1)
    return words, pairs, np.array(lengths, dtype=np.float64)


def _shared(a: list[set], b: list[set]) -> np.ndarray:
    """Sizes of all intersections."""
    place: dict = {}
    for s in a:
        for x in s:
            place.setdefault(x, len(place))

    def matrix(sets: list[set]) -> np.ndarray:
        out = np.zeros((len(sets), len(place)), dtype=np.float32)
        for k, s in enumerate(sets):
            out[k, [place[x] for x in s if x in place]] = 1
        return out

    return (matrix(a) @ matrix(b).T).astype(np.float64)


def tile_similarities(candidates: list[str], references: list[str], first: tuple[int, int]) -> np.ndarray:
    """(size of candidates, size of references, candidate, reference) -> similarity of the blocks that end there; -1 where a block begins before the lists."""
    (aw, ap, al), (bw, bp, bl) = (block_sets(keys, f, most) for keys, f, (most, _) in zip((candidates, references), first, SIDES))
    size = lambda sets: np.array([len(s) for s in sets], dtype=np.float64)
    ratio = lambda p, q: np.divide(p, q, out=np.zeros(np.broadcast(p, q).shape), where=q > 0)
    both, two = _shared(aw, bw), _shared(ap, bp)
    x, y, u, v = size(aw)[:, None], size(bw)[None, :], size(ap)[:, None], size(bp)[None, :]
    lengths = np.minimum(al[:, None], bl[None, :]), np.maximum(al[:, None], bl[None, :])
    # The order of the sums is that of ``alignment.similarity``: the same doubles.
    out = WEIGHTS["containment"] * ratio(both, np.minimum(x, y)) + WEIGHTS["dice"] * ratio(2 * both, x + y) + WEIGHTS["bigram_dice"] * ratio(2 * two, u + v) + WEIGHTS["length"] * ratio(*lengths)
    out[(al < 0)[:, None] | (bl < 0)[None, :]] = -1
    n, m = len(candidates) - first[0], len(references) - first[1]
    return out.reshape(MAX_CANDIDATES, n, MAX_REFERENCES, m).transpose(0, 2, 1, 3)


def _tiles(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sparse similarities of one tile; the keys of either side begin with what lies before the tile."""
    document, ti, tj = (k.as_py() for k in key)
    cells, values = np.empty(0, np.int32), np.empty(0)
    if left.num_rows and right.num_rows:
        sides = []
        for table, tile in ((left, ti), (right, tj)):
            table = table.sort_by("place")
            sides.append((table["match_key"].to_pylist(), int((np.asarray(table["place"]) < tile * TILE).sum())))
        (a, fa), (b, fb) = sides
        if len(a) > fa and len(b) > fb:
            found = np.full((MAX_CANDIDATES, MAX_REFERENCES, TILE, TILE), -1.0)
            made = tile_similarities(a, b, (fa, fb))
            found[:, :, : made.shape[2], : made.shape[3]] = made
            flat = found.ravel()
            cells = np.flatnonzero(flat >= LEAST).astype(np.int32)
            values = flat[cells]
    return pa.table({"document_id": [document], "ti": pa.array([ti], pa.int32()), "tj": pa.array([tj], pa.int32()), "cells": pa.array([cells], pa.list_(pa.int32())), "similarities": pa.array([values], pa.list_(pa.float64()))})


class Programme:
    """One document's programme, fed with rows of tiles in order."""

    def __init__(self, n: int, m: int, block_penalty: float):
        self.n, self.m, self.penalty = n, m, _whole(block_penalty)
        self.skip = _whole(SKIP)
        # The last rows of scores, for the rows before the current one.
        self.rows = [self.skip * np.arange(m + 1, dtype=np.int64)]
        self.choices = np.zeros((n + 1, m + 1), dtype=np.int8)
        self.choices[0] = 1
        self.scores = np.zeros((n + 1, m + 1))

    def add(self, similar: np.ndarray) -> None:
        """Next row of candidates: similarities (size of candidates, size of references, reference), -1 for none."""
        i, options = len(self.rows), []
        for p in range(1, min(MAX_CANDIDATES, i) + 1):
            for q in range(1, MAX_REFERENCES + 1):
                s = similar[p - 1, q - 1]
                value = np.full(self.m + 1, np.iinfo(np.int64).min // 2)
                at = np.flatnonzero(s >= LEAST) + 1
                at = at[at >= q]
                value[at] = self.rows[i - p][at - q] + np.rint(s[at - 1] * UNIT).astype(np.int64) - self.penalty * (p + q - 2)
                options.append((2 + (p - 1) * MAX_REFERENCES + q - 1, value, s))
        up = self.rows[i - 1] + self.skip
        base = np.maximum.reduce([up, *(v for _, v, _ in options)])
        steps = self.skip * np.arange(self.m + 1, dtype=np.int64)
        best = np.maximum.accumulate(base - steps) + steps
        left = np.concatenate([[np.iinfo(np.int64).min // 2], best[:-1] + self.skip])
        choice = np.full(self.m + 1, -1, dtype=np.int8)
        choice[best == up] = 0
        choice[(choice < 0) & (best == left)] = 1
        for code, value, s in options:
            taken = (choice < 0) & (best == value)
            choice[taken] = code
            at = np.flatnonzero(taken)
            self.scores[i, at] = s[at - 1]
        self.choices[i] = choice
        self.rows.append(best)
        if i >= MAX_CANDIDATES:
            self.rows[i - MAX_CANDIDATES] = None

    def blocks(self) -> list[tuple[int, int, int, int, float]]:
        """(first candidate, end, first reference, end, similarity) in order."""
        out, i, j = [], self.n, self.m
        while i or j:
            code = int(self.choices[i, j])
            p, q = ((1, 0), (0, 1))[code] if code < 2 else ((code - 2) // MAX_REFERENCES + 1, (code - 2) % MAX_REFERENCES + 1)
            out.append((i - p, i, j - q, j, float(self.scores[i, j]) if code > 1 else 0.0))
            i, j = i - p, j - q
        return out[::-1]


BLOCKS = "document_id string, block int, c_from int, c_to int, r_from int, r_to int, similarity double"


def _solved(block_penalty: float):
    """Rows of (document, tile, cells) in order, a row of tile -1 with the document's sizes first -> its blocks."""

    def finish(document: str, programme: Programme) -> pa.RecordBatch:
        rows = [(document, k, *b) for k, b in enumerate(programme.blocks())]
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.string(), *[pa.int32()] * 5, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, programme, band, tile = None, None, None, -1

        def flush() -> None:
            """The rows of the row of tiles that is complete."""
            if band is not None:
                for a in range(min(TILE, programme.n - tile * TILE)):
                    programme.add(band[:, :, a, : programme.m])

        for batch in batches:
            for row in range(batch.num_rows):
                ti = batch.column("ti")[row].as_py()
                if ti < 0:
                    if programme is not None:
                        flush()
                        yield finish(document, programme)
                    document, band, tile = batch.column("document_id")[row].as_py(), None, -1
                    n, m = batch.column("n")[row].as_py(), batch.column("m")[row].as_py()
                    programme = Programme(n, m, block_penalty)
                    if not m:
                        for _ in range(n):
                            programme.add(np.empty((MAX_CANDIDATES, MAX_REFERENCES, 0)))
                    continue
                if ti != tile:
                    flush()
                    tile, band = ti, np.full((MAX_CANDIDATES, MAX_REFERENCES, TILE, -(-programme.m // TILE) * TILE), -1.0)
                cells = np.asarray(batch.column("cells")[row].values)
                p, q, a, b = np.unravel_index(cells, (MAX_CANDIDATES, MAX_REFERENCES, TILE, TILE))
                band[p, q, a, b + batch.column("tj")[row].as_py() * TILE] = np.asarray(batch.column("similarities")[row].values)
        if programme is not None:
            flush()
            yield finish(document, programme)

    return run


def relationships(candidates: str, references: str, score: str) -> str:
    """SQL of ``alignment.relationship``."""
    return f"case when {references} = 0 then 'unmatched_candidate' when {candidates} = 0 then 'workbook_only' when {candidates} = 1 and {references} = 1 then if({score} >= 1 - 1e-9, 'exact', 'fuzzy') when {references} = 1 then 'merge' when {candidates} = 1 then 'split' else 'complex' end"


def align(candidates: DataFrame, references: DataFrame, key: str = "document_id", block_penalty: float = BLOCK_PENALTY) -> DataFrame:
    """Blocks (document_id, block, candidate_ids, reference_ids, similarity, relationship), those of ``alignment.align_texts``.

    Both sides hold key, item_id, item_order and match_key; equal orders go by id, null match keys
    are empty. A document on one side only has skipped items alone. Similarities of a document are
    worked out tile by tile in tasks of their own; its last pass holds 9 bytes for every pair of a
    candidate and a reference.
    """

    def placed(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col(key).cast("string").alias("document_id"), F.col("item_id").cast("string").alias("item_id"), "item_order", F.coalesce("match_key", F.lit("")).alias("match_key"))
        return own.withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy("item_order", "item_id")) - 1).drop("item_order")

    left, right = placed(candidates), placed(references)
    ids = lambda rows, name: rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"]).alias(name))
    none = F.array().cast("array<string>")
    documents = ids(left, "c").join(ids(right, "r"), "document_id", "full").select("document_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    sizes = documents.select("document_id", F.size("c").alias("n"), F.size("r").alias("m"))

    def dealt(rows: DataFrame, own: str, other: str, size: str, reach: int) -> DataFrame:
        """A row for each tile that it lies in, or within ``reach`` before, by each tile of the other side."""
        tile = F.floor(F.col("place") / TILE).cast("int")
        mine = F.when((F.col("place") % TILE >= TILE - reach), F.array(tile, tile + 1)).otherwise(F.array(tile))
        met = rows.join(sizes.filter("n > 0 and m > 0").select("document_id", F.col(size).alias("size")), "document_id")
        met = met.withColumn(own, F.explode(mine)).withColumn(other, F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / TILE).cast("int"))))
        return met.select("document_id", "ti", "tj", "place", "match_key")

    keys = ["document_id", "ti", "tj"]
    a, b = dealt(left, "ti", "tj", "m", MAX_CANDIDATES - 1), dealt(right, "tj", "ti", "n", MAX_REFERENCES - 1)
    shape = "document_id string, ti int, tj int, cells array<int>, similarities array<double>"
    tiles = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_tiles, shape)
    nothing = lambda t: F.lit(None).cast(t)
    heads = sizes.select("document_id", F.lit(-1).alias("ti"), F.lit(0).alias("tj"), nothing("array<int>").alias("cells"), nothing("array<double>").alias("similarities"), "n", "m")
    both = tiles.withColumns({"n": nothing("int"), "m": nothing("int")}).unionByName(heads)
    solved = both.repartition("document_id").sortWithinPartitions(*keys).mapInArrow(_solved(block_penalty), BLOCKS)
    cut = lambda c, low, high: F.slice(c, F.col(low) + 1, F.col(high) - F.col(low))
    out = solved.join(documents, "document_id").select("document_id", "block", cut("c", "c_from", "c_to").alias("candidate_ids"), cut("r", "r_from", "r_to").alias("reference_ids"), "similarity")
    return out.withColumn("relationship", F.expr(relationships("size(candidate_ids)", "size(reference_ids)", "similarity")))
