"""Exact top-k inner products by ball trees and branch and bound.

The space is cut into balls by a tree over a bounded sample; every row goes to its ball, and each
ball's radius is the largest distance of any of its rows. A ball of more than ``SHARD_ROWS`` rows is
dealt out over several shards by hash, so equal vectors don't meet in one task. A shard's task
builds a ball tree over its rows (memory bounded by the shard), then takes the queries as a stream
of blocks. For a query ``q`` a ball with centre ``c`` and radius ``r`` holds no product above
``q.c + |q| r``; balls below the query's current kth score are dropped, the others are opened in the
order of that bound. Queries first visit a shard of the ball with the highest bound; the kth scores
found there decide which other shards they are sent to at all, and are where those begin to prune.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch

SHARD_ROWS = 20_000
LEAF_ROWS = 128
#: Rows that the cuts of the space are taken from; results never depend on them.
SAMPLE_ROWS = 20_000
#: Most balls for vectors of one length, and most lengths that are cut at all: the table of balls stays below some 20 MB.
MAX_BALLS, MAX_LENGTHS = 512, 16
#: Queries handled together; more are taken block by block.
BLOCK = 512
_EXACT = 2.0**53
_NONE = -(2**62)


class BallTree:
    """Ball tree over integer rows, level by level: ``levels`` holds (starts, centres, radii)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.wide = self.rows.astype(np.float64)
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF_ROWS)))
        place, spans = np.arange(len(ids)), [(0, len(ids))]
        splits = [spans]
        for _ in range(depth):
            nxt = []
            for low, high in spans:
                own = self.wide[place[low:high]]
                # Halves by the widest axis; equal rows still split, so leaves stay small.
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if own.shape[1] and len(own) else 0
                mid = (low + high) // 2
                if own.shape[1] and len(own) > 1:
                    place[low:high] = place[low:high][np.argpartition(own[:, axis], mid - low)]
                nxt += [(low, mid), (mid, high)]
            spans = nxt
            splits.append(spans)
        self.ids, self.rows, self.wide = self.ids[place], self.rows[place], self.wide[place]
        self.spans = spans
        self.levels = []
        for spans in splits:
            centres = np.stack([self.wide[a:b].mean(axis=0) if b > a else np.zeros(self.wide.shape[1]) for a, b in spans])
            radii = np.array([np.sqrt(((self.wide[a:b] - c) ** 2).sum(axis=1).max()) if b > a else -np.inf for (a, b), c in zip(spans, centres)])
            self.levels.append((centres, radii))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of up to k best rows of each query with a score of at least ``kth``, best first."""
        wide = queries.astype(np.float64)
        norms = np.sqrt((wide**2).sum(axis=1))
        largest = np.abs(wide).max(initial=0) * np.abs(self.wide).max(initial=0) * max(1, wide.shape[1])
        kth = kth.astype(np.float64)
        exact = largest < _EXACT
        found = [(np.empty(0, np.int64), np.empty(0, object)) for _ in queries]
        best = np.full((len(queries), k), _NONE, dtype=np.int64)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        alive = np.ones((len(queries), 1), dtype=bool)
        bound = None
        for level, (centres, radii) in enumerate(self.levels):
            if level:
                alive = np.repeat(alive, 2, axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                bound = wide @ centres.T + norms[:, None] * radii[None, :]
            # Rounding of the bound must not lose a row: widen it by far more than its error.
            bound = bound + 1e-9 * (np.abs(bound) + norms[:, None] * np.abs(np.where(np.isfinite(radii), radii, 0))[None, :]) + 1e-3
            bound[~np.isfinite(bound) & (radii >= 0)[None, :]] = np.inf
            alive &= (bound >= kth[:, None]) & (radii >= 0)[None, :]
        ranked = np.argsort(-np.where(alive, bound, -np.inf), axis=1, kind="stable")
        for turn in range(ranked.shape[1]):
            leaf = ranked[:, turn]
            at = np.arange(len(queries))
            going = at[alive[at, leaf] & (bound[at, leaf] >= kth)]
            if not len(going):
                break
            for one in np.unique(leaf[going]):
                group, (a, b) = going[leaf[going] == one], self.spans[one]
                if not exact:
                    self._wide_numbers(group, a, b, query_ids, queries, kth, k, found)
                    continue
                scores = (wide[group] @ self.wide[a:b].T).astype(np.int64)
                scores[self.ids[None, a:b] == query_ids[group][:, None]] = _NONE
                some = scores.max(axis=1) >= kth[group]
                group, scores = group[some], np.concatenate([best[group[some]], scores[some]], axis=1)
                ids = np.concatenate([best_ids[group], np.broadcast_to(self.ids[a:b], (len(group), b - a))], axis=1)
                order = np.lexsort((ids, -scores), axis=-1)[:, :k]
                best[group], best_ids[group] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
                kth[group] = np.maximum(kth[group], best[group, -1])
        return [(i[s > _NONE], s[s > _NONE]) for i, s in zip(best_ids, best)] if exact else found

    def _wide_numbers(self, group, a, b, query_ids, queries, kth, k, found) -> None:
        """As above with Python integers, where products pass the exact doubles."""
        scores = queries[group].astype(object) @ self.rows[a:b].astype(object).T
        for row, q in zip(scores, group):
            other = self.ids[a:b] != query_ids[q]
            ids, best = np.concatenate([found[q][0], self.ids[a:b][other]]), np.concatenate([found[q][1], row[other]])
            order = np.array(sorted(range(len(ids)), key=lambda j: (-best[j], ids[j])), dtype=np.int64)[:k]
            found[q] = (ids[order], best[order])
            if len(order) == k:
                # Below in floating point where rounding could lift the kth score.
                last = float(found[q][1][-1])
                kth[q] = max(kth[q], last - abs(last) * 1e-9)


class Space:
    """Cuts of the space by a sample of integer rows of one length: ``balls`` leaves with their centres."""

    def __init__(self, sample: np.ndarray, balls: int):
        self.cuts: list[list[tuple[int, float]]] = []
        spans = [np.arange(len(sample))]
        wide = sample.astype(np.float64)
        while 2 * len(spans) <= min(balls, MAX_BALLS) and len(sample) >= 64 * len(spans) and wide.shape[1]:
            level, parts = [], []
            for at in spans:
                own = wide[at]
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(at) else 0
                middle = float(np.median(own[:, axis])) if len(at) else 0.0
                level.append((axis, middle))
                parts += [at[own[:, axis] < middle], at[own[:, axis] >= middle]] if len(at) else [at, at]
            self.cuts.append(level)
            spans = parts
        self.centres = np.stack([wide[at].mean(axis=0) if len(at) else np.zeros(wide.shape[1]) for at in spans])

    def ball(self, rows: np.ndarray) -> np.ndarray:
        out, wide = np.zeros(len(rows), dtype=np.int64), rows.astype(np.float64)
        for level in self.cuts:
            axes, middles = np.array([c[0] for c in level]), np.array([c[1] for c in level])
            out = 2 * out + (wide[np.arange(len(rows)), axes[out]] >= middles[out])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, values = len(flat), flat.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(n, -1) if n and len(values) else np.zeros((n, 0), np.int64)


def _by_length(batch: pa.RecordBatch, column: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length in the batch."""
    lengths = batch.column(length).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, _matrix(batch.column(column).take(pa.array(at)))


def _placed(spaces: dict[int, Space]):
    """(.., vector, dims) -> with the ball of each row and its distance from the ball's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ball, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for n, at, rows in _by_length(batch, batch.num_columns - 2, batch.num_columns - 1):
                if n in spaces:
                    ball[at] = own = spaces[n].ball(rows)
                    far[at] = np.sqrt(((rows - spaces[n].centres[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(far)], names=[*batch.schema.names, "ball", "far"])

    return run


def _sent(spaces: dict[int, Space], balls: dict[int, dict[int, tuple[float, int]]], first: bool):
    """(vec_id, vector, dims[, home_ball, home_part, kth]) -> a row for each shard that a query is sent to.

    ``balls``: length -> ball -> (radius, shards). ``first``: one shard of the ball with the highest bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ball, part = [], [], []
            ids = batch.column(0).to_numpy()
            if not first:
                home = [batch.column(k).to_pylist() for k in (3, 4, 5)]
            for n, at, queries in _by_length(batch, 1, 2):
                held = sorted(balls.get(n, {}).items())
                wide = queries.astype(np.float64)
                centres = np.stack([spaces[n].centres[k] if n in spaces else np.zeros(wide.shape[1]) for k, _ in held])
                radii = np.array([r for _, (r, _) in held])
                reach = np.sqrt((wide**2).sum(axis=1))[:, None] * radii[None, :]
                with np.errstate(invalid="ignore", over="ignore"):
                    bound = wide @ centres.T + reach
                    bound = bound + 1e-9 * (np.abs(bound) + reach) + 1e-3
                bound[~np.isfinite(bound)] = np.inf
                for q, row in enumerate(at):
                    if first:
                        k, (_, parts) = held[int(np.argmax(bound[q]))]
                        targets = [(k, int(ids[row]) % parts)]
                    else:
                        least = -np.inf if home[2][row] is None else float(home[2][row])
                        least = -np.inf if abs(least) >= _EXACT else least
                        targets = [(k, j) for (k, (_, parts)), b in zip(held, bound[q]) if b >= least for j in range(parts) if (k, j) != (home[0][row], home[1][row])]
                    rows += [row] * len(targets)
                    ball += [t[0] for t in targets]
                    part += [t[1] for t in targets]
            at = pa.array(rows, pa.int64())
            kth = pa.nulls(len(rows), pa.int64()) if first else batch.column(5).take(at)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), pa.array(ball, pa.int32()), pa.array(part, pa.int32()), pa.array([1] * len(rows), pa.int32()), batch.column(0).take(at), batch.column(1).take(at), kth], names=["dims", "ball", "part", "kind", "vec_id", "vector", "kth"])

    return run


def integer_vector(column: str) -> F.Column:
    """floor(256 * x) of every component; null where a component or the array is null or not finite."""
    fine = F.expr(f"{column} is not null and forall({column}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))")
    return F.when(fine, F.expr(f"transform({column}, x -> floor(256D * cast(x as double)))"))


def _searched(k: int):
    """Rows of a shard, sorted: candidates (kind 0) before queries (kind 1)."""

    def answer(tree: BallTree | None, asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(asked)
        if tree is None or not block.num_rows:
            return
        ids = block.column("vec_id").to_numpy()
        found = tree.search(ids, _matrix(block.column("vector")), np.array([-np.inf if x is None else float(x) for x in block.column("kth").to_pylist()]), k)
        query, vec, score = [], [], []
        for q, (near, scores) in zip(ids, found):
            query += [int(q)] * len(near)
            vec += near.tolist()
            score += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, rows, asked, n = None, None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.array([f"{d}/{i}/{j}" for d, i, j in zip(*(batch.column(c).to_pylist() for c in ("dims", "ball", "part")))])
            kind = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (kind[1:] != kind[:-1])) + 1), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if key[low] != shard:
                    if asked:
                        yield from answer(tree, asked)
                    shard, tree, rows, asked, n = key[low], None, [], [], 0
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    rows.append(part)
                    continue
                if tree is None and rows:
                    held = pa.Table.from_batches(rows)
                    tree, rows = BallTree(held.column("vec_id").to_numpy(), _matrix(held.column("vector"))), []
                asked.append(part)
                n += part.num_rows
                if n >= BLOCK:
                    yield from answer(tree, asked)
                    asked, n = [], 0
        if asked:
            yield from answer(tree, asked)

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, ties to the smaller id.

    Candidates are all rows but those of the query's own id. Vectors that are null or hold a null
    or non-finite component, and rows with a null id, take no part. Vectors of different length
    are not compared; empty ones score 0 with each other. Components and scores beyond the range
    of a long are cut to it and tie. Rows under one id are candidates each; an id asked by several
    rows is answered for the least of their vectors. An empty table gives none. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "ball-tree")
    made = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("vector is not null")
    made = scratch.save(made.select("vec_id", "asks", "vector", F.size("vector").alias("dims")), "vectors")

    # The commonest lengths are cut; a bounded sample in hashed order.
    lengths = {r["dims"]: r["n"] for r in made.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(MAX_LENGTHS).collect()}
    spaces: dict[int, Space] = {}
    for n, rows in lengths.items():
        if (wanted := math.ceil(rows / shard_rows)) > 1:
            sample = made.filter(F.col("dims") == n).select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE_ROWS).toArrow()
            spaces[n] = Space(_matrix(sample.column("vector")), 4 * wanted)
    placed = scratch.save(made.mapInArrow(_placed(spaces), "vec_id long, asks boolean, vector array<long>, dims int, ball int, far double"), "placed")
    # One row a ball of a length that is cut, and one for each other length.
    sizes = scratch.save(placed.groupBy("dims", "ball").agg(F.count("*").alias("n"), F.max("far").alias("radius")).select("dims", "ball", "radius", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "sizes")
    candidates = placed.join(F.broadcast(sizes) if len(lengths) < MAX_LENGTHS else sizes, ["dims", "ball"]).select(
        "dims", "ball", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("long").alias("kth")
    )
    candidates = scratch.save(candidates, "candidates")
    queries = scratch.save(placed.filter("asks").groupBy("vec_id", "dims").agg(F.min("vector").alias("vector")).groupBy("vec_id").agg(F.min_by(F.struct("vector", "dims"), F.struct("vector")).alias("v")).select("vec_id", "v.vector", "v.dims"), "queries")
    balls: dict[int, dict[int, tuple[float, int]]] = {}
    asked = queries.select("dims").distinct()
    for r in sizes.join(asked, "dims").collect():
        balls.setdefault(r["dims"], {})[r["ball"]] = (math.inf if r["dims"] not in spaces else r["radius"], r["parts"])
    shape = "dims int, ball int, part int, kind int, vec_id long, vector array<long>, kth long"

    def searched(sent: DataFrame) -> DataFrame:
        parts = candidates.unionByName(sent).repartition("dims", "ball", "part").sortWithinPartitions("dims", "ball", "part", "kind")
        return parts.mapInArrow(_searched(k), "query_id long, vec_id long, score long")

    first = scratch.save(queries.mapInArrow(_sent(spaces, balls, True), shape), "first")
    home = scratch.save(searched(first), "home")
    shared = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).alias("kth"))
    away = first.drop("kth", "kind").join(shared, "vec_id", "left").select("vec_id", "vector", "dims", "ball", "part", "kth")
    others = searched(away.mapInArrow(_sent(spaces, balls, False), shape))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(others).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
