"""Periodic runs of words, located by block convolution at dyadic scales.

A run is a stretch of words with a smallest period q that no neighbouring word
extends, at least ``LEAST`` words and ``TIMES`` periods long. At scale B = 1, 2,
4, ... the runs with B <= q < 2B are found. Such a run holds several whole blocks
of B words that start at multiples of B, and each of them occurs again q words
further on. A number theoretic transform gives the sum of squared differences
between a block and every place of the window that follows it, as an exact
integer; where it is zero the block occurs. Distances at which enough blocks in
a row occur again are seeds: they are extended word by word to both sides, and
those of sufficient length whose period is the smallest are runs.

Words are compared by numbers given to the distinct words of a batch, so equal
numbers are equal words. The sums are exact: as many primes are used as the
largest possible sum asks for. Two rules leave work out and no run: a word of a
run occurs ``TIMES`` times in it, so runs lie between words that are rarer; and a
block that lies with its copy in a known run of a smaller period seeds nothing new,
by the theorem of Fine and Wilf.
"""

from __future__ import annotations

from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

LEAST, TIMES = 6, 4
# primes 1 + k * 2^26 and a primitive root of each; all three hold sums of 90 bits
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
CELLS = 1 << 20  # numbers that are transformed at once
WIDEST = 1 << 22  # largest block; longer periods are searched window by window
ROUNDS = 8  # of the search for stretches of frequent words

RUNS = "array<struct<start long, length long, period long>>"


def _mod(x: np.ndarray, p: int) -> np.ndarray:
    return x - x // np.uint64(p) * np.uint64(p)


@cache
def _roots(p: int, root: int, size: int) -> list[np.ndarray]:
    """Powers of the roots of unity of order size, size / 2, ..., 2."""
    out = []
    while size > 1:
        w = pow(root, (p - 1) // size, p)
        powers, step = np.ones(size // 2, np.uint64), 1
        while step < size // 2:
            powers[step : 2 * step] = _mod(powers[:step] * np.uint64(pow(w, step, p)), p)[: size // 2 - step]
            step *= 2
        out.append(powers)
        size //= 2
    return out


def _transform(x: np.ndarray, p: int, roots: list[np.ndarray]) -> np.ndarray:
    """Of each row; places come out in bit-reversed order."""
    rows, size = x.shape
    for powers in roots:
        half = len(powers)
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        y = np.empty_like(x)
        y[:, :, 0] = _mod(a + b, p)
        y[:, :, 1] = _mod((a + np.uint64(p) - b) * powers, p)
        x = y
    return x.reshape(rows, size)


def _restore(x: np.ndarray, p: int, inverse: list[np.ndarray]) -> np.ndarray:
    """The inverse of ``_transform`` for places in bit-reversed order."""
    rows, size = x.shape
    for powers in reversed(inverse):
        half = len(powers)
        x = x.reshape(rows, -1, 2, half)
        a, b = x[:, :, 0], _mod(x[:, :, 1] * powers, p)
        y = np.empty_like(x)
        y[:, :, 0] = _mod(a + b, p)
        y[:, :, 1] = _mod(a + np.uint64(p) - b, p)
        x = y
    return _mod(x.reshape(rows, size) * np.uint64(pow(size, -1, p)), p)


def products(blocks: np.ndarray, windows: np.ndarray, p: int, root: int) -> np.ndarray:
    """Sums over k of blocks[k] * windows[t + k] modulo p, for each row and each t below the block's length."""
    rows, width = blocks.shape
    size = 2 * width
    there, back = _roots(p, root, size), _roots(p, pow(root, -1, p), size)
    f, g = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
    f[:, :width] = blocks[:, ::-1]
    g[:, : windows.shape[1]] = windows
    both = _mod(_transform(f, p, there) * _transform(g, p, there), p)
    return _restore(both, p, back)[:, width - 1 : size - 1]


def _occurrences(x: np.ndarray, starts: np.ndarray, width: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in starts, t) where the block equals the words t further on, ahead <= t < ahead + width."""
    most = int(x.max()) ** 2 * width
    primes = PRIMES[: 1 if most < PRIMES[0][0] else 2 if most < PRIMES[0][0] * PRIMES[1][0] else 3]
    padded = np.concatenate([x, np.zeros(ahead + 2 * width, np.int64)]).astype(np.uint64)
    zero = None
    at, found = [], []
    step = max(1, CELLS // (2 * width))
    for low in range(0, len(starts), step):
        part = starts[low : low + step, None]
        blocks = padded[part + np.arange(width)]
        windows = padded[part + ahead + np.arange(2 * width - 1)]
        zero = np.ones(blocks.shape, bool)
        for p, root in primes:
            squares = np.zeros((len(part), 2 * width), np.uint64)
            np.cumsum(_mod(windows * windows, p), axis=1, out=squares[:, 1:])
            own = _mod(blocks * blocks, p).sum(1, keepdims=True)
            total = own + squares[:, width:] - squares[:, :width]
            zero &= _mod(total, p) == _mod(np.uint64(2) * products(blocks, windows, p, root), p)
        i, t = np.nonzero(zero)
        at.append(i + low)
        found.append(t + ahead)
    return np.concatenate(at), np.concatenate(found)


def _divisors(t: int) -> list[int]:
    """t divided by each of its prime factors."""
    out, rest, q = [], t, 2
    while q * q <= rest:
        if rest % q == 0:
            out.append(t // q)
            while rest % q == 0:
                rest //= q
        q += 1
    return out + ([t // rest] if rest > 1 else [])


def _scale(x, ends, size, width, ahead, reach):
    """Runs (start, end, period) with ahead <= period < ahead + width, from blocks of ``width`` words."""
    starts = np.arange(0, len(x), width)
    starts = starts[(size[starts] >= max(LEAST, TIMES * ahead)) & (starts + ahead + width <= ends[starts])]
    if not len(starts):
        return []
    at, t = _occurrences(x, starts, width, ahead)
    i = starts[at]
    good = (i + t + width <= ends[i]) & (i + t + width > reach[i])
    i, t = i[good], t[good]
    order = np.lexsort((i, t))
    i, t = i[order], t[order]
    if not len(i):
        return []
    new = np.ones(len(i), bool)
    new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1] + width)
    first = np.flatnonzero(new)
    blocks = np.diff(np.append(first, len(i)))
    t = t[first]
    s, e = i[first], i[first] + blocks * width
    same = np.maximum(LEAST, TIMES * t) - t  # words of a run that equal the one t further on
    enough = blocks >= (same + 1) // width - 1
    s, e, t = s[enough], e[enough], t[enough]
    stop = ends[s] if len(s) else s
    begin = stop - size[s] if len(s) else s
    out = set()
    step = max(1, CELLS // width)
    for low in range(0, len(s), step):
        part = slice(low, low + step)
        a, b, d = s[part, None], e[part, None], t[part, None]
        steps = np.arange(width)
        left, right = a - 1 - steps, b + steps
        alike = (left >= begin[part, None]) & (x[np.maximum(left, 0)] == x[np.maximum(left, 0) + d])
        a = a[:, 0] - np.logical_and.accumulate(alike, axis=1).sum(1)
        inside = right + d < stop[part, None]
        right = np.where(inside, right, 0)
        alike = inside & (x[right] == x[right + d])
        b = b[:, 0] + np.logical_and.accumulate(alike, axis=1).sum(1)
        d = d[:, 0]
        long = b + d - a >= np.maximum(LEAST, TIMES * d)
        out.update(zip(a[long].tolist(), (b + d)[long].tolist(), d[long].tolist()))
    return [
        (a, b, d)
        for a, b, d in sorted(out)
        if not any(np.array_equal(x[a : a + d], x[a + q : a + q + d]) for q in _divisors(d))
    ]


def find_runs(x: np.ndarray, ends: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of numbers from 1 on; ``ends`` and ``size`` of each place's stretch.

    Stretches are apart by a 0 at least, and a run lies in one of them.
    """
    out: list[tuple[int, int, int]] = []
    longest = int(size.max()) if len(size) else 0
    reach = np.zeros(len(x), np.int64)
    ahead = 1
    while longest >= max(LEAST, TIMES * ahead):
        width = min(ahead, WIDEST)
        found = []
        for window in range(ahead, 2 * ahead, width):
            found += _scale(x, ends, size, width, window, reach)
        out += found
        if found and 2 * ahead <= WIDEST:
            begin, end, _ = np.array(found).T
            np.maximum.at(reach, begin, end)
            np.maximum.accumulate(reach, out=reach)
        ahead *= 2
    return out


def _stretches(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and each one's stretch, numbered from 0."""
    place, group = np.arange(len(codes)), row
    for _ in range(ROUNDS):
        if not len(place):
            break
        _, kind = np.unique(group * (int(codes.max()) + 1) + codes[place], return_inverse=True)
        often = np.bincount(kind)[kind] >= TIMES
        left, of = place[often], group[often]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (of[1:] != of[:-1])
        stretch = np.cumsum(new) - 1
        enough = np.bincount(stretch, minlength=1)[stretch] >= LEAST if len(stretch) else np.zeros(0, bool)
        done = len(left) == len(place) and enough.all()
        place = left[enough]
        group = np.unique(stretch[enough], return_inverse=True)[1]
        if done:
            break
    return place, group


def runs_of_words(words: W.Words) -> list[tuple[int, int, int]]:
    """(first word, word after the last, period) of the runs of all rows, by place among all words."""
    if not len(words.start):
        return []
    codes, _ = words.codes()
    place, group = _stretches(codes, words.row_of_word())
    if not len(place):
        return []
    held = np.bincount(group)
    at = np.arange(len(place)) + group  # one 0 after each stretch
    x = np.zeros(len(place) + len(held), np.int64)
    x[at] = np.unique(codes[place], return_inverse=True)[1] + 1
    after = np.cumsum(held + 1) - 1
    of = np.repeat(np.arange(len(held)), held + 1)
    ends, size = after[of], held[of]
    size[after] = 0
    word = np.zeros(len(x), np.int64)
    word[at] = place
    found = find_runs(x, ends, size)
    return [(int(word[a]), int(word[b - 1]) + 1, q) for a, b, q in found]


def _finder():
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in W.pieces(batch.column(1)):
                words = W.Words(data, offsets)
                found = sorted(runs_of_words(words), key=lambda r: (r[0], r[2]))
                begin, end, period = np.array(found, np.int64).reshape(-1, 3).T
                gone = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(gone, begin + period, 1)
                np.add.at(gone, end, -1)
                kept = np.cumsum(gone[:-1]) == 0
                row = np.searchsorted(words.ptr, begin, side="right") - 1
                ends = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
                names = ["start", "length", "period"]
                cells = [pa.array(c) for c in (begin - words.ptr[row], end - begin, period)]
                raw, texts = data.tobytes(), []
                for r in range(high - low):
                    a, b = words.ptr[r], words.ptr[r + 1]
                    own = raw[offsets[r] : offsets[r + 1]].split()
                    texts.append(b" ".join(own if kept[a:b].all() else compress(own, kept[a:b].tolist())))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(words.count.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cells, names)),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of ``docs``, in map tasks only.

    ``runs`` are sorted by start, then period; starts are word numbers from 0. ``collapsed`` has the
    words that no run covers after its first period, joined by one space. Null and empty texts have
    no words and no runs; repeated rows and rows with a null id are judged each by its own text.
    Other columns are ignored; an empty table gives an empty result. A text is worked on whole, in
    memory that grows with its length.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = texts.mapInArrow(_finder(), f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)
