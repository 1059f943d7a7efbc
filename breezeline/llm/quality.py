"""Document statistics, and gradient-boosted trees over them that judge quality.

Trees are grown on the driver from a bounded sample of labelled rows, with the
logistic loss, on histograms of the features' quantiles. Chosen features are
monotonic: more of them never raises the score. The forest is flattened into
node arrays, so that a batch descends all trees by array indexing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W

SAMPLE = 20_000  # labelled rows at most that the trees are grown from
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 64, 20

#: name of a feature and how the score may follow it: -1 never up, 0 freely
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "end_share": 0,
    "bang_share": -1,
    "pipe_share": -1,
    "wide_share": 0,
}

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_COUNTS = [x.split()[0] for x in STATS.split(", ")]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = _class(b"#*$%&|<>")
_UPPER = _class(bytes(range(65, 91)))
_DIGIT = _class(bytes(range(48, 58)))
_MARK = _class(b".,;:!?'\"()-")
_END = _class(b".!?:\"'")
_BANG = _class(b"!")
_PIPE = _class(b"|")
_NEXT = np.zeros(256, bool)
_NEXT[0x80:0xC0] = True  # a code point's further bytes


def _statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The five counts of each row, and its features."""
    words = W.Words(data, offsets)
    rows = len(offsets) - 1

    def total(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def words_with(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[words.ptr[1:]] - sums[words.ptr[:-1]]

    hashes = words.hashes()
    of = words.row_of_word()
    starts, each = W.window_starts(words, 3)
    windows = W.windows(hashes, 3)[starts]
    row = np.repeat(np.arange(rows), each)
    order = np.lexsort((windows, row))
    same = (windows[order][1:] == windows[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.start), bool)
    for i in range(3):
        covered[starts[twice] + i] = True

    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=rows)

    raw = data.tobytes()
    dup_lines, lines = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for r in range(rows):
        own = [x for x in raw[offsets[r] : offsets[r + 1]].split(b"\n") if x.strip()]
        lines[r], dup_lines[r] = len(own), len(own) - len(set(own))
    n = words.count.astype(np.int64)
    chars = total(words.solid & ~_NEXT[data])
    symbols = total(_SYMBOL[data])
    counts = [n, chars, symbols, dup_lines, words_with(covered)]
    last = data[words.end - 1] if len(words.end) else data[:0]
    some, letters = np.maximum(n, 1), np.maximum(chars, 1)
    features = np.column_stack([
        np.log1p(n), chars / some, symbols / letters, dup_lines / np.maximum(lines, 1), counts[4] / some,
        total(_UPPER[data]) / letters, total(_DIGIT[data]) / letters, total(_MARK[data]) / letters,
        distinct / some, n / np.maximum(lines, 1), words_with(_END[last]) / some, total(_BANG[data]) / some,
        total(_PIPE[data]) / some, total(data >= 0xC0) / letters,
    ])
    return counts, features


class Forest:
    """Boosted trees of one depth as arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float):
        self.base, self.feature, self.split, self.leaf = base, [], [], []

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is good."""
        total = np.full(len(x), self.base)
        if self.feature:
            feature, split, leaf = np.array(self.feature), np.array(self.split), np.array(self.leaf)
            trees, rows = np.arange(len(leaf)), np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(leaf)), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[trees, node]] > split[trees, node])
            total += leaf[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotonic: list[int], trees: int = TREES) -> Forest:
    """Fits a forest to features ``x`` and labels ``y``."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.999
    forest = Forest(float(np.log(share / (1 - share))))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    total = np.full(len(y), forest.base)
    inner, outer = 2**DEPTH - 1, 2**DEPTH
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, split = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + outer, -np.inf), np.full(inner + outer, np.inf)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            best = (1e-3, None)
            g_all, h_all = grad[own].sum(), hess[own].sum()
            for f, c in enumerate(cuts):
                if not len(c) or len(own) < 2 * LEAF:
                    continue
                b = bins[own, f]
                g = np.cumsum(np.bincount(b, grad[own], len(c) + 1))[:-1]
                h = np.cumsum(np.bincount(b, hess[own], len(c) + 1))[:-1]
                n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                left, right = g / (h + 1), (g_all - g) / (h_all - h + 1)
                gain = g * left + (g_all - g) * right - g_all**2 / (h_all + 1)
                fit = (n >= LEAF) & (len(own) - n >= LEAF)
                if monotonic[f]:
                    fit &= monotonic[f] * (right - left) >= 0
                gain = np.where(fit, gain, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (f, at, left[at], right[at]))
            left_node, right_node = 2 * i + 1, 2 * i + 2
            for child in (left_node, right_node):
                low[child], high[child] = low[i], high[i]
            if best[1]:
                f, at, left, right = best[1]
                feature[i], split[i] = f, cuts[f][at]
                if monotonic[f]:  # what lies below either side keeps to its side of the middle
                    middle = np.clip((left + right) / 2, low[i], high[i])
                    if monotonic[f] > 0:
                        high[left_node], low[right_node] = middle, middle
                    else:
                        low[left_node], high[right_node] = middle, middle
                node[own] = np.where(bins[own, f] > at, right_node, left_node)
            else:
                node[own] = left_node
        at = node - inner
        value = np.bincount(at, grad, outer) / (np.bincount(at, hess, outer) + 1)
        value = RATE * np.clip(value, low[inner:], high[inner:])
        forest.feature.append(feature)
        forest.split.append(split)
        forest.leaf.append(value)
        total += value[at]
    return forest


def _measured(batches):
    for batch in batches:
        for low, high, data, offsets in W.pieces(batch.column(1)):
            counts, x = _statistics(data, offsets)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            arrays = [batch.column(0).slice(low, high - low), *map(pa.array, counts)]
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(x.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *_COUNTS, "features"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Forest:
    """A forest from at most ``sample`` labelled rows, those with the least hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    known = known.dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(known.select("id")), "id", "left_semi")
    rows = texts.mapInArrow(_measured, f"id long, {STATS}, features array<double>")
    table = rows.select("id", "features").join(F.broadcast(known), "id").select("id", "features", "label").toArrow()
    x = np.array(table.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(table.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, table.column("id").to_numpy()))
    return grow(x[order], y[order], list(FEATURES.values()))


def judge(
    docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row.

    A row is kept if it passes the base rules (50 words or more, at most half of
    them in repeated 3-word windows) and the forest's score is ``least`` or more.
    Null and empty texts have no words and fail. Ids may be null or repeated;
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in W.pieces(batch.column(1)):
                counts, x = _statistics(data, offsets)
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                score = forest.score(x)
                arrays = [batch.column(0).slice(low, high - low), *map(pa.array, counts)]
                arrays += [pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["id", *_COUNTS, "base_failed", "kept", "score"]
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, f"id long, {STATS}, base_failed boolean, kept boolean, score double")
    return out.withColumnRenamed("id", id_col)
