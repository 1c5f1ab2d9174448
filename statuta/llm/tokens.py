"""Exact tokenizer ids and counts with a word memo.

The library spends most of its time on words it has seen before. Where a tokenizer's pieces
can't cross a boundary in the text, the ids of the parts are the ids of the text, so parts are
looked up in a memo and only new ones are encoded. Texts with anything unusual (special token
strings, control characters, characters beyond Latin, odd white space) go to the library whole.
Memos are bounded; results never depend on them.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a memo, more or less a batch: a bound on memory only, results never depend on it.
MEMO = 300_000
#: Characters up to U+024F are stable under NFC and have the same lower case everywhere.
_UNUSUAL = re.compile("[^\\x09-\\x0d\\x20-\\x84\\x86-ɏ]|<\\|")
#: Control characters but white space, and lead bytes from U+0240 on.
_ODD_BYTE = np.array([b < 9 or 13 < b < 32 or b >= 0xC9 for b in range(256)])
#: White space that is not a single blank or line feed between two other characters.
_ODD_SPACE = re.compile("\\s\\s|^\\s|\\s$|[^\\S \\n]")

#: Fixed value: what the word vocabulary takes for a word.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; an existing path is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(other)}


_LETTERS = _byte_letters()


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class WordIds:
    """Ids of whole texts as little-endian 16-bit bytes, for vocabularies below 65,536 that drop white space.

    One object serves one task, so a reused Python worker keeps nothing. A memo that is full
    takes no more entries: the frequent words come early.
    """

    def __init__(self, path: str):
        self.library = _library(path)
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids need more than 16 bits")
        shape = json.load(open(path, encoding="utf-8"))
        steps = (shape["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        # The memo holds for: keep what the pattern finds (runs of letters, single digits, runs of
        # other marks, English endings after an apostrophe), no white space in it, then byte letters.
        split = steps[0].get("behavior") == "Removed" and steps[0].get("invert") and len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        lowered = [x["type"] for x in (shape["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.memo_holds = bool(split and lowered and steps[0]["pattern"]["Regex"] == _WORDS)
        if self.memo_holds:
            import regex

            self.chunks = _Chunks(_Words(self.library.model.tokenize), regex.compile(_WORDS).findall)

    def ids(self, text: str | None, plain: bool = False) -> bytes:
        """Null counts as empty; ``plain``: known to hold nothing unusual."""
        if not text:
            return b""
        if not self.memo_holds or not plain and _UNUSUAL.search(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def ids_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow string column."""
        data, offsets = text_bytes(texts)
        plain = np.diff(np.concatenate([[0], np.cumsum(_suspicious(data))])[offsets]) == 0
        return [self.ids(x, ok) for x, ok in zip(texts.to_pylist(), plain.tolist())]


class _Words(dict):
    """word that the pattern found, in lower case -> ids."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize = tokenize

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))
        made = _packed([t.id for t in self.tokenize(letters)])
        if len(self) < MEMO:
            self[word] = made
        return made


class _Chunks(dict):
    """Run without white space -> ids."""

    def __init__(self, words: _Words, found):
        super().__init__()
        self.words, self.found = words, found

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            made = self.words[low]
        elif low[:-1].isalpha():  # a word and one mark or digit after it
            made = self.words[low[:-1]] + self.words[low[-1]]
        else:
            made = b"".join(map(self.words.__getitem__, self.found(low)))
        if len(self) < MEMO:
            self[chunk] = made
        return made


def _suspicious(data: np.ndarray) -> np.ndarray:
    """Bytes without which a UTF-8 text holds nothing unusual."""
    out = _ODD_BYTE[data]
    out[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0x85) | (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    return out


def _packed(ids: list[int]) -> bytes:
    made = array("H", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class TextCounts:
    """Token counts of whole texts for the byte-level vocabulary whose pattern lets a word take the blank before it."""

    def __init__(self, path: str):
        self.library = _library(path)
        shape = json.load(open(path, encoding="utf-8"))
        self.memo_holds = shape["normalizer"] is None and shape["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _fill(self, memo: dict[str, int], missing: set[str], lead: str) -> None:
        if len(memo) + len(missing) > MEMO:
            memo.clear()
        missing = list(missing)
        for word, found in zip(missing, self.library.encode_batch_fast([lead + w for w in missing], add_special_tokens=False)):
            memo[word] = len(found.ids)

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Counts in the order given; null counts as empty."""
        plain, whole, out = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            if text:
                (whole if not self.memo_holds or _UNUSUAL.search(text) or _ODD_SPACE.search(text) else plain).append(k)
        for k, found in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False) if whole else []):
            out[k] = len(found.ids)
        heads, tails = [], []
        for k in plain:
            lines = [x.split(" ") for x in texts[k].split("\n")]
            heads.append([x[0] for x in lines])
            tails.append([w for x in lines for w in x[1:]])
        # A memo may start afresh between two fills, never between filling and looking up.
        new = set().union(*heads) - self.first.keys() if heads else set()
        if new:
            self._fill(self.first, new if len(self.first) + len(new) <= MEMO else set().union(*heads), "")
        new = set().union(*tails) - self.later.keys() if tails else set()
        if new:
            self._fill(self.later, new if len(self.later) + len(new) <= MEMO else set().union(*tails), " ")
        first, later = self.first.__getitem__, self.later.__getitem__
        for k, head, tail in zip(plain, heads, tails):
            # Every line feed between two other characters is one token of its own.
            out[k] = len(head) - 1 + sum(map(first, head)) + sum(map(later, tail))
        return out


@lru_cache(maxsize=2)
def text_counts(path: str) -> TextCounts:
    return TextCounts(path)
