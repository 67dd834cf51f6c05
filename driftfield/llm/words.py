"""Words, shingles and their hashes from Arrow string columns, without a Python loop per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; letters A-Z count
as a-z.  Hashes are 64-bit: a polynomial over the bytes, taken as a difference of
running sums, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {int(_BASE): np.ones(1, np.uint64), int(_INVERSE): np.ones(1, np.uint64)}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of words that consist of letters only (all bytes of other scripts count as letters).
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def _power(base: np.uint64, n: int) -> np.ndarray:
    kept = _powers[int(base)]
    if len(kept) < n:
        grown = np.full(max(n, 2 * len(kept), BLOCK_BYTES), base, np.uint64)
        grown[0] = 1
        kept = _powers[int(base)] = np.multiply.accumulate(grown)
    return kept[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a run of documents: bytes [start, end) of ``data``, ``first[i]:first[i + 1]`` of document i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash per word, or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
        return mix((sums[end] - sums[self.start]) * _power(_INVERSE, n + 1)[self.start])

    def strings(self) -> pa.Array:
        """The words themselves, as binary values."""
        size = self.end - self.start
        offsets = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        inside = _INSIDE[self.data]
        return pa.Array.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[inside].tobytes())]
        )


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is an empty text."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_in(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _INSIDE) -> Words:
    """The words of documents whose bytes are ``data[offsets[i]:offsets[i + 1]]``; ``kind`` tells which bytes words have."""
    data = _LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(starts)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def word_blocks(
    texts: pa.Array, block_bytes: int = BLOCK_BYTES, kind: np.ndarray = _INSIDE
) -> Iterator[tuple[int, int, Words]]:
    for at, to, data, offsets in text_blocks(texts, block_bytes):
        yield at, to, words_in(data, offsets, kind)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words; a shorter document is one run of all its words."""
    h = words.hashes()
    count = np.diff(words.first)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(words.docs), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + words.first[owner]
    stop = words.first[owner + 1]
    out = np.zeros(len(owner), np.uint64)
    for k in range(size):
        here = at + k < stop
        part = np.where(here, h[np.minimum(at + k, len(h) - 1)] if len(h) else 0, np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(k + 1)
    return owner, mix(out)
