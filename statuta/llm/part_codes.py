"""Compression of vectors to part codes: integer k-means over the parts of a vector, by tree aggregation.

A vector's components become integers and are cut into equal consecutive parts; every part position
has a codebook of its own. Vectors are written once as blocks, one NumPy array by component, and
every round is an RDD ``treeAggregate`` over them: distances to the entries grow component by
component, ``np.add.at`` gathers sums and counts of each entry in int64 tensors, and these merge two
by two through a tree, so the driver gets a few tensors of the codebooks' size whatever the rows.
All arithmetic is on integers, so codes don't depend on partitioning, order or lost executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows and components that a block holds at most; a bound on memory only.
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 20
#: Tensors that one step of the merging tree takes, and that reach the driver at the end, about.
FAN_IN = 16
#: Sums and squared distances stay below this in int64; larger components are taken as Python integers.
_SAFE = 2**62
_LARGEST = 2**63 - 1


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, exact for every finite double."""
    made = [math.floor(scale * x) if abs(x) < 1e290 else math.floor(x) * scale for x in values.ravel().tolist()]
    return np.array(made, dtype=object).reshape(values.shape)


def _block(raw: bytes, dims: int, wide: bool, scale: int) -> np.ndarray:
    """(component, row) integers of a stored block."""
    if wide:
        return _integers(np.frombuffer(raw, dtype="<f8").reshape(dims, -1), scale)
    return np.frombuffer(raw, dtype="<i4").reshape(dims, -1).astype(np.int64)


def _blocks(dims: int, wide: bool, scale: int):
    """Arrow batches of (id, label key, vector) -> blocks."""
    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dims))

    def made(ids: list, keys: list, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, keys = (pa.chunked_array(x).combine_chunks() for x in (ids, keys))
        values = np.concatenate(rows)
        for low in range(0, len(ids), most):
            own = values[low : low + most].T
            raw = np.ascontiguousarray(own if wide else np.floor(own * scale), dtype="<f8" if wide else "<i4").tobytes()
            names = ["ids", "keys", "raw"]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids[low : low + most].to_pylist(), keys[low : low + most].to_pylist(), raw), (pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, rows, held = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            keys.append(batch.column(1))
            rows.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims))
            held += batch.num_rows
            if held >= most:
                yield from made(ids, keys, rows)
                ids, keys, rows, held = [], [], [], 0
        if held:
            yield from made(ids, keys, rows)

    return run


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower index) and its squared distance, both (part, row).

    ``block``: (component, row); ``books``: (part, entry, position within the part).
    """
    parts, entries, width = books.shape
    codes = np.empty((parts, block.shape[1]), dtype=np.int64)
    errors = np.empty((parts, block.shape[1]), dtype=block.dtype)
    for p in range(parts):
        away = np.zeros((entries, block.shape[1]), dtype=block.dtype)
        for j in range(width):
            apart = block[p * width + j][None, :] - books[p, :, j][:, None]
            away += apart * apart
        codes[p] = np.argmin(away, axis=0)
        errors[p] = np.take_along_axis(away, codes[p][None, :], axis=0)[0]
    return codes, errors


def gather(block: np.ndarray, books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add a block's parts to the sums and counts of their entries."""
    width = books.shape[2]
    codes, _ = assign(block, books)
    for p, code in enumerate(codes):
        np.add.at(counts[p], code, 1)
        for j in range(width):
            np.add.at(sums[p, :, j], code, block[p * width + j])


def refined(blocks, books: np.ndarray, wide: bool, scale: int) -> np.ndarray:
    """Codebooks after one round over the RDD of stored blocks."""
    sent = blocks.context.broadcast(books)  # entries x components, whatever the rows
    parts, entries, width = books.shape
    dims = parts * width

    def add(state, raw):
        if state is None:
            state = np.zeros(books_shape, dtype=object if wide else np.int64), np.zeros(books_shape[:2], dtype=np.int64)
        gather(_block(raw, dims, wide, scale), sent.value, *state)
        return state

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    books_shape = books.shape
    depth = max(2, math.ceil(math.log(max(2, blocks.getNumPartitions()), FAN_IN)))
    sums, counts = blocks.treeAggregate(None, add, merge, depth)
    sent.destroy()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _coded(books: np.ndarray, wide: bool, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = books.shape[0] * books.shape[2]
        for batch in batches:
            for ids, keys, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                codes, errors = assign(_block(raw, dims, wide, scale), books)
                code = [row.tobytes().hex() for row in np.ascontiguousarray(codes.T, dtype=np.uint8)]
                error = [min(x, _LARGEST) for x in errors.sum(axis=0).tolist()]
                columns = (pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(code), pa.array(error, pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "key", "code", "error"])

    return run


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usable(vector_col: str) -> str:
    """SQL: the vector holds finite numbers only."""
    v = f"`{vector_col}`"
    return f"{v} is not null and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def part_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", return_books: bool = False
) -> DataFrame | tuple[DataFrame, np.ndarray]:
    """A row a vector: vec_id, code, error, label_error, codebooks_sha256; with ``return_books`` also the codebooks.

    Vectors that are null or hold null or non-finite components take no part. All others must be as
    long as the one with the smallest id (least vector among equal ids); those of another length, and
    all where that length is no multiple of ``parts``, take no part either. Entries begin as the
    parts of the vectors with the smallest ids (nulls last), fewer than ``entries`` if there are fewer
    vectors. Repeated rows and ids each get a row and weigh in each; null ids keep their row. Null
    labels are one label. Errors beyond a long are the largest long. An empty table gives no row.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes two hex digits: 1 to 256 entries")
    scratch = Scratch(spark, "part-codes")
    key = F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("null"))
    fine = vectors.filter(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), key.alias("key"), F.col(vector_col).cast("array<double>").alias("vector"))
    first = fine.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    dims = len(first[0].vector) if first else 0
    if not dims or dims % parts:
        empty = spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        return (empty, np.zeros((parts, 0, 0), dtype=np.int64)) if return_books else empty

    fine = fine.filter(F.size("vector") == dims)
    rows, largest = fine.agg(F.count(F.lit(1)), F.max(F.expr("array_max(transform(vector, x -> abs(x)))"))).first()
    bound = math.ceil(largest) * scale + 1
    wide = bound >= 2**31 or dims * (2 * bound) ** 2 >= _SAFE or rows * bound >= _SAFE
    stored = scratch.save(fine.mapInArrow(_blocks(dims, wide, scale), "ids array<long>, keys array<string>, raw binary"), "blocks")

    start = [r.vector for r in fine.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    books = _integers(np.array(start, dtype=np.float64), scale).reshape(len(start), parts, dims // parts).transpose(1, 0, 2)
    books = books if wide else books.astype(np.int64)
    blocks = stored.select("raw").rdd.map(lambda row: bytes(row[0]))
    for _ in range(rounds):
        books = refined(blocks, books, wide, scale)

    coded = scratch.save(stored.mapInArrow(_coded(books, wide, scale), "vec_id long, key string, code string, error long"), "coded")
    summed = F.sum(F.col("error").cast("decimal(38,0)"))
    # Written, so that the join has a shuffle of its own and a hot label can be split.
    by_label = scratch.save(coded.groupBy("key").agg(F.least(summed, F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    found = coded.join(by_label, "key").select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
    return (found, books) if return_books else found


def codes_sql() -> str:
    """The same rows for DuckDB, a table a step. Rows have distinct ids and equal lengths there."""
    fine = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    down = "(case when sum(x) < 0 then -((-sum(x) + count(*) - 1) // count(*)) else sum(x) // count(*) end)"
    steps = [
        f"v as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e from embeddings where {fine})",
        f"p as materialized (select vec_id, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] as s from v, range({PARTS}) r(part))",
        f"b0 as materialized (select part, entry, s as c from p join (select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit {ENTRIES}) using (vec_id))",
    ]
    near = "select p.vec_id, p.part, p.s, min({'d': cast(list_sum(list_transform(list_zip(p.s, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), 'entry': b.entry}) as n from p join b%d b using (part) group by all"
    for k in range(ROUNDS):
        steps += [
            f"a{k} as materialized ({near % k})",
            f"m{k} as (select part, entry, list(y order by pos) as c from (select part, n.entry as entry, pos, cast({down} as bigint) as y from (select part, n, unnest(s) as x, unnest(range(len(s))) as pos from a{k}) group by all) group by all)",
            f"b{k + 1} as materialized (select o.part, o.entry, coalesce(m{k}.c, o.c) as c from b{k} o left join m{k} using (part, entry))",
        ]
    steps += [
        f"z as materialized ({near % ROUNDS})",
        "coded as (select vec_id, string_agg(printf('%02x', n.entry), '' order by part) as code, cast(sum(n.d) as bigint) as error from z group by vec_id)",
        f"hashed as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})",
    ]
    listed = ",\n".join(steps)
    return f"with {listed}\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join v using (vec_id), hashed"
