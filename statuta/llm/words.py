"""Words and word shingles as 64-bit hashes, for the operators that compare whole texts.

Texts stay in their Arrow buffers: words are found and hashed by array operations over the bytes,
without a Python object a word. A word's hash is a polynomial over random 64-bit values of its
bytes, read off running sums, and mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import mix

_U = np.uint64
#: White space: blank and \t \n \v \f \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed together, and texts are taken together; a bound on memory only, results never depend on it.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
#: The same with A-Z folded to a-z.
_FOLDED = _VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_POWERS: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        made = [np.cumprod(np.concatenate([np.ones(1, dtype=_U), np.full(max(n, CHUNK) - 1, base, dtype=_U)]), dtype=_U) for base in (_BASE, _BACK)]
        if n > 2 * CHUNK:  # one word of that length: not kept
            return made
        _POWERS[:] = made
    return _POWERS


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and where its texts begin and end in them; a null is empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, at, held = texts.buffers()
    n = len(texts)
    places = np.frombuffer(at, dtype=np.int32, count=n + 1, offset=4 * texts.offset).astype(np.int64) if n else np.zeros(1, np.int64)
    low, high = int(places[0]), int(places[-1])
    return np.frombuffer(held, dtype=np.uint8)[low:high] if held is not None and high > low else np.empty(0, np.uint8), places - low


class Words:
    """Words of the texts of an Arrow string column, all in arrays.

    ``data``: the bytes; ``offsets``: where texts begin and end in them; ``starts``, ``ends``: of
    the words; ``first``: number of the first word of each text, and of the end.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[self.data]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        # A text's end ends a word.
        cuts = self.offsets[1:-1][(self.offsets[1:-1] > 0) & (self.offsets[1:-1] < len(self.data))]
        begins[cuts] |= inside[1:-1][cuts]
        ends[cuts - 1] |= inside[1:-1][cuts - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A hash of each word; ``fold``: with A-Z lower-cased."""
        values, out = _FOLDED if fold else _VALUES, np.empty(len(self.starts), dtype=_U)
        a = 0
        while a < len(out):
            low = int(self.starts[a])
            b = max(a + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            high = int(self.ends[b - 1])
            up, down = _powers(high - low)
            running = np.zeros(high - low + 1, dtype=_U)
            np.cumsum(values[self.data[low:high]] * up[: high - low], dtype=_U, out=running[1:])
            s, e = self.starts[a:b] - low, self.ends[a:b] - low
            out[a:b] = mix((running[e] - running[s]) * down[s] + (e - s).astype(_U))
            a = b
        return out

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many of the bytes in ``mask`` each text has."""
        return np.diff(self._upto(mask)[self.offsets])

    def per_word(self, mask: np.ndarray) -> np.ndarray:
        upto = self._upto(mask)
        return upto[self.ends] - upto[self.starts]

    @staticmethod
    def _upto(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=out[1:])
        return out


def pieces(batch: pa.RecordBatch, column: int, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``CHUNK`` bytes of text; one long text is a slice."""
    upto, low = text_bytes(batch.column(column))[1], 0
    while low < batch.num_rows:
        high = int(np.searchsorted(upto, upto[low] + CHUNK, side="right")) - 1
        high = min(max(high, low + 1), low + rows)
        yield batch.slice(low, high - low)
        low = high


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = max(0, len(hashes) - size + 1)
    out = mix(hashes[:n] + _U(size))
    for k in range(1, size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word windows, words ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased; a shorter text is one window of itself, one without words the empty set."""
    found = Words(texts)
    hashes, first, out = found.hashes(), found.first.tolist(), []
    whole = windows(hashes, size)
    for a, b in zip(first, first[1:]):
        out.append(np.unique(whole[a : b - size + 1]) if b - a >= size else windows(hashes[a:b], b - a) if b > a else np.empty(0, dtype=_U))
    return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), size)[0]
