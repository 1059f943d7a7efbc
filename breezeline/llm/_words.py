"""Words of whole Arrow text columns, found and hashed in bulk.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. Hashes are
64 bits wide; they do not depend on the batch a text arrives in.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20  # bytes of text worked on at once; a longer text is a piece of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.default_rng(20240607)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z count as a-z
LONG = 64  # bytes
_SALTS = _rng.integers(0, 2**64, 6, np.uint64)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def coded(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Words given as their letters end to end: a number for each, and the distinct words by number."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    found = words.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def hashes_of(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of the words that lie at these places of ``data``.

    Eight bytes at a time are mixed into what came before, so that no pattern of letters cancels
    out; words of more than ``LONG`` bytes get a keyed cryptographic hash.
    """
    salts = _SALTS[3 * key : 3 * key + 3]
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) + salts[0])
    live = np.flatnonzero(size <= LONG)
    at, left, h = start[live], size[live], out[live]
    while len(live):
        lane = lanes[at] & _LOW[np.minimum(left, 8)]
        h = mix((h + salts[1]) ^ mix(lane ^ salts[2]))
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > LONG):
        word = data[start[i] : start[i] + size[i]].tobytes()
        out[i] = int.from_bytes(blake2b(word, digest_size=8, key=b"word%d" % key).digest(), "little")
    return out


class Words:
    """start, end: byte places of each word; ptr: the first word of each row, and the total."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
        self.data = data
        n = len(data)
        space = between[data]
        opens, closes = np.empty(n, bool), np.empty(n, bool)
        if n:
            opens[0] = closes[-1] = True
            opens[1:], closes[:-1] = space[:-1], space[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            opens[inner] = True
            closes[inner - 1] = True
        self.solid = ~space
        self.start = np.flatnonzero(opens & self.solid)
        self.end = np.flatnonzero(closes & self.solid) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.ptr)

    def codes(self, fold: bool = False) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words, and the distinct words; fold: with A-Z as a-z."""
        letters = self.data[self.solid]
        if fold:
            letters = FOLD[letters]
        return coded(letters, self.end - self.start)

    def hashes(self, fold: bool = False, key: int = 0) -> np.ndarray:
        """A hash for each word; fold: with A-Z as a-z; hashes of two keys are independent."""
        return hashes_of(FOLD[self.data] if fold else self.data, self.start, self.end - self.start, key)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` words, across row ends too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total += hashes[i : i + n] * _PLACE[i % 64] + np.uint64(i // 64)
    return mix(total)


def window_starts(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that lie within one row, and how many each row has."""
    each = np.maximum(words.count - length + 1, 0)
    first = np.cumsum(each) - each
    starts = np.arange(int(each.sum())) - np.repeat(first, each) + np.repeat(words.ptr[:-1], each)
    return starts, each
