"""Word tables and rolling hashes over Arrow text columns.

Tasks read whole record batches as one byte buffer and work on it with numpy, so no
Python object is made for a text or a word.  Texts are UTF-8; null counts as empty.

A word hash is a polynomial in random 64-bit values of its bytes, finished by a mixer;
a window hash is the same polynomial over the hashes of its words.  Both come from
prefix sums, so the cost does not depend on the length of a word or a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that a task turns into arrays at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _spread(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


BYTE_VALUES = _spread(256, 11)
_WORD_BASE, _WINDOW_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class _Powers:
    """Powers of an odd base modulo 2^64, and those of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for b in (self.base, self.inverse):
                a = np.full(n, U64(b))
                a[0] = 1
                made.append(np.multiply.accumulate(a))
            if n > 4 * SLICE_BYTES:  # not worth keeping
                return made[0], made[1]
            self.up, self.down = made
        return self.up[:n], self.down[:n]


word_powers, window_powers = _Powers(_WORD_BASE), _Powers(_WINDOW_BASE)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes between words: `[^\x20\x09-\x0D]+` are words.
BLANKS = byte_table((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` are words, of lower-cased text.
NON_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words are runs of letters (and of whatever is not ASCII), of lower-cased text.
NON_LETTERS = byte_table((0x00, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin-1 letters (UTF-8 C3 80 to C3 9E without the times sign)."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    at = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    out[at] += 0x20
    return out


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about `most` bytes of text, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Words of the rows of a batch: byte ranges, and the first word of each row (and the total)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = word_powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(BYTE_VALUES[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = ~blanks[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which `size` words of one row start, and the hashes of those windows."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    up, down = window_powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return at, mix((sums[at + size] - sums[at]) * down[at])
