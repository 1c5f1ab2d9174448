"""Packing along a Hilbert curve.

Token ids are hashed to random signs, so a document's vector of hashed token counts is projected
to ``DIMS`` numbers; its direction is a cell of a grid, and the cell's place on the Hilbert curve
is the sort key. Documents that lie near each other on the curve share sequences.

The order is made on narrow rows (key, length): a range sort, a running sum in every range and
the ranges' totals give every document the place of its first token in one endless stream, which
is cut every ``length`` tokens. All sequences but the last are full. Token ids are stored once,
compressed, and joined to their place by row, evenly however alike the documents are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch, mix
from .tokens import WordIds, tokenizer_path
from .words import pieces

DIMS, BITS = 4, 10
END_ID = 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates below ``2**bits``."""
    x = cells.astype(np.int64).T.copy()
    n, high = len(x), 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = high
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: Four signs of each id as bits in lanes of 16 bits, so that one sum counts all of them.
_SIGNS = sum((mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) >> np.uint64(8 * k) & np.uint64(1)) << np.uint64(16 * k) for k in range(DIMS))


def document_cell(ids: np.ndarray) -> np.ndarray:
    """Grid cell of a document's direction; the empty document lies in the middle."""
    ups = np.zeros(DIMS, dtype=np.int64)
    for low in range(0, len(ids), 65535):
        lanes = int(_SIGNS[ids[low : low + 65535]].sum(dtype=np.uint64))
        ups += [lanes >> 16 * k & 0xFFFF for k in range(DIMS)]
    at = (2 * ups - len(ids)).astype(np.float64)
    norm = np.sqrt((at * at).sum()) or 1.0
    return np.minimum(((at / norm + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordIds(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, 1):
                raw = encoder.ids_all(part.column(1))
                cells = np.stack([document_cell(np.frombuffer(x, dtype="<u2")) for x in raw])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(hilbert_keys(cells)),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array([len(x) // 2 + 1 for x in raw], pa.int64()),
                        pa.array([packer.compress(x) for x in raw], pa.binary()),
                    ],
                    names=["doc_id", "curve", "tie", "doc_tokens", "packed"],
                )

    return run


def _pieces(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, place, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                ids = np.append(np.frombuffer(unpacker.decompress(packed), dtype="<u2"), np.uint16(END_ID)).astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    offset = (place + start) % length
                    size = min(length - offset, total - start)
                    piece = ids[start : start + size]
                    row = (doc_id, start, size, zlib.crc32(piece.tobytes()), total, (place + start) // length, offset)
                    for column, value in zip(out, (*row, piece.tolist()) if with_ids else row):
                        column.append(value)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 7 else pa.list_(pa.int64())) for k, x in enumerate(out)], names=names[: len(out)])

    return run


def pack_documents(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A document's tokens are its ids followed by the end id; null and empty texts have the end id
    alone. Every token lies in exactly one piece. Null ids, repeated ids and repeated rows are
    packed like any other row. An empty table gives no piece. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, curve long, tie long, doc_tokens long, packed binary"
    # The row number is stored with the row: it only ties the two uses of this table together.
    stored = scratch.save(src.mapInArrow(_tokenized(tokenizer_path(tokenizer)), schema).withColumn("row", F.monotonically_increasing_id()), "tokens")

    order = ["curve", "tie", "doc_id", "row"]
    narrow = stored.select(*order, "doc_tokens").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    narrow = scratch.save(narrow, "order")
    totals = narrow.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # One row a range, as many as shuffle partitions at most.
    before = totals.withColumn("before", F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).select("part", "before")
    within = F.sum("doc_tokens").over(W.partitionBy("part").orderBy(*order)) - F.col("doc_tokens")
    places = narrow.withColumn("within", within).join(F.broadcast(before), "part").select("row", (F.col("within") + F.col("before")).alias("place"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return stored.join(places, "row").select("doc_id", "place", "packed").mapInArrow(_pieces(length, with_ids), schema)
