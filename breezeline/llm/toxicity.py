"""Toxicity by a bidirectional gated recurrent network with attention pooling.

The network reads windows of ``WINDOW`` words, each overlapping half of the one
before, and a text scores as its worst window. A word comes in as a word input
(how much more often its hash is seen in toxic texts) and character inputs (the
same for its four- and five-byte pieces), so unseen words are read by their
parts. Training, on the driver in numpy, takes a bounded sample of labelled
rows; the labels of a text do not enter its own inputs there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._memory import give_back, lean

TOXIC_ROWS, CLEAN_ROWS = 2000, 4000  # labelled rows at most that the network is trained on
TRAIN_BYTES = 20_000  # longer labelled texts are not trained on (all are scored whole)
WINDOW, STEP, HIDDEN, INPUTS = 32, 16, 8, 6
BUCKETS = 1 << 18
EPOCHS, BATCH, RATE = 6, 128, 0.01


def _word_parts(data, start, end):
    """(hash of each four- and five-byte piece of each word with its ends marked, word of the piece)."""
    size = end - start
    first = np.cumsum(size + 2) - (size + 2)
    total = int((size + 2).sum())
    letters = np.full(total, 1, np.uint64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    raw = data[np.repeat(start, size) + inside]
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    letters[np.repeat(first + 1, size) + inside] = raw + np.uint64(2)
    owner = np.repeat(np.arange(len(size)), size + 2)
    hashes, owners = [], []
    for n in (4, 5):
        if total < n:
            continue
        value = np.zeros(total - n + 1, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x100000001B3) + letters[i : total - n + 1 + i]
        same = owner[: total - n + 1] == owner[n - 1 :]
        hashes.append(W.mix(value[same]))
        owners.append(owner[: total - n + 1][same])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def _bucket(hashes):
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


class Lexicon:
    """In how many toxic and clean training texts each word and piece bucket is seen."""

    def __init__(self):
        self.words = np.zeros((2, BUCKETS), np.float32)
        self.parts = np.zeros((2, BUCKETS), np.float32)
        self.texts = np.zeros(2)

    @staticmethod
    def _odds(counts, texts, buckets, own):
        """Smoothed log odds; ``own`` is the label of the text that the buckets are of, if counted."""
        toxic, clean = counts[1][buckets], counts[0][buckets]
        if own is not None:
            toxic, clean = toxic - own, clean - (1 - own)
        ratio = (toxic + 0.5) / (clean + 0.5 * max(texts[0], 1) / max(texts[1], 1)) * (max(texts[0], 1) / max(texts[1], 1))
        return np.log(np.maximum(ratio, 1e-3)) * ((toxic + clean) / (toxic + clean + 2))

    def inputs(self, data, start, end, hashes, own=None) -> np.ndarray:
        """The inputs of each word."""
        word = self._odds(self.words, self.texts, _bucket(hashes), own)
        parts, owner = _word_parts(data, start, end)
        odds = self._odds(self.parts, self.texts, _bucket(parts), own)
        most, least, mean = (np.zeros(len(start)) for _ in range(3))
        if len(parts):
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            which = owner[at]
            most[which], least[which] = np.maximum.reduceat(odds, at), np.minimum.reduceat(odds, at)
            mean[which] = np.add.reduceat(odds, at) / np.diff(np.append(at, len(odds)))
        size = np.log1p(end - start) - 1.7
        known = (self.words[:, _bucket(hashes)].sum(0) > (0 if own is None else 1)).astype(float)
        return np.column_stack([word, most, mean, least, size, known]).astype(np.float32)


def _window_table(count: np.ndarray, first: np.ndarray, pad: int):
    """(word numbers of each window, row of each window); rows without words have none."""
    each = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STEP)), 0)
    row = np.repeat(np.arange(len(count)), each)
    start = (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)) * STEP
    spot = start[:, None] + np.arange(WINDOW)
    return np.where(spot < count[row][:, None], spot + first[row][:, None], pad), row


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Two GRUs, forth and back, whose states are pooled by attention into one logit."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, INPUTS
        self.p = {}
        for side in "fb":
            self.p["W" + side] = rng.normal(0, d**-0.5, (d, 3 * h)).astype(np.float32)
            self.p["c" + side] = np.zeros(3 * h, np.float32)
            self.p["U" + side] = rng.normal(0, 0.6 * h**-0.5, (h, 3 * h)).astype(np.float32)
        self.p["a"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["v"] = rng.normal(0, 0.3, 2 * h).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0  # of a text's worst logit, from the training texts

    def project(self, x):
        return {side: x @ self.p["W" + side] + self.p["c" + side] for side in "fb"}

    def _run(self, side, gates, keep, index=None, tape=None):
        """States of one direction; gates are of words, picked by ``index`` if given."""
        h = HIDDEN
        n = len(keep) if index is None else len(index)
        u = self.p["U" + side]
        uz, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state, states = np.zeros((n, h), np.float32), np.zeros((n, WINDOW, h), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = gates[index[:, t]] if index is not None else gates[:, t]
            zr = _sigmoid(x[:, : 2 * h] + state @ uz)
            z, r = zr[:, :h] * keep[:, t : t + 1], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + (r * state) @ un)
            if tape is not None:
                tape.append((t, state, zr[:, :h], r, new))
            state = state + z * (new - state)
            states[:, t] = state
        return states

    def logits(self, gates, keep, index):
        """Logits of windows of word numbers; keep is 1 where there is a word."""
        states = np.concatenate([self._run(s, gates[s], keep, index) for s in "fb"], axis=2)
        energy = states @ self.p["a"] + (keep - 1) * 1e4
        weight = np.exp(energy - energy.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        return ((states @ self.p["v"]) * weight).sum(1) + self.p["o"][0]

    def gradients(self, x, keep, y, share):
        """Gradients of the weighted logistic loss for windows of inputs (n, WINDOW, INPUTS)."""
        h, p, g = HIDDEN, self.p, {}
        tapes, halves = {}, []
        for s in "fb":
            tapes[s] = []
            halves.append(self._run(s, x @ p["W" + s] + p["c" + s], keep, tape=tapes[s]))
        states = np.concatenate(halves, axis=2)
        energy = states @ p["a"] + (keep - 1) * 1e4
        weight = np.exp(energy - energy.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = (states * weight[:, :, None]).sum(1)
        logit = pooled @ p["v"] + p["o"][0]
        d = ((_sigmoid(logit) - y) * share / len(y)).astype(np.float32)
        g["o"], g["v"] = d.sum(keepdims=True), pooled.T @ d
        own = states @ p["v"]
        de = weight * (own - (own * weight).sum(1, keepdims=True)) * d[:, None]
        g["a"] = np.einsum("nth,nt->h", states, de)
        ds = weight[:, :, None] * p["v"] * d[:, None, None] + de[:, :, None] * p["a"]
        for k, s in enumerate("fb"):
            u = p["U" + s]
            back = np.zeros((len(y), h), np.float32)
            g["U" + s], dx = np.zeros_like(u), np.zeros((len(y), WINDOW, 3 * h), np.float32)
            for t, old, z, r, new in reversed(tapes[s]):
                m = keep[:, t : t + 1]
                dh = back + ds[:, t, k * h : (k + 1) * h]
                dn = dh * z * m * (1 - new**2)
                dz = dh * (new - old) * m * z * (1 - z)
                du = dn @ u[:, 2 * h :].T
                dr = du * old * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                g["U" + s][:, : 2 * h] += old.T @ gates
                g["U" + s][:, 2 * h :] += (r * old).T @ dn
                back = dh * (1 - z * m) + du * r + gates @ u[:, : 2 * h].T
                dx[:, t] = np.concatenate([gates, dn], axis=1)
            g["W" + s] = np.einsum("ntd,ntg->dg", x, dx)
            g["c" + s] = dx.sum((0, 1))
        return g


class Model:
    def __init__(self, lexicon: Lexicon, network: Network):
        self.lexicon, self.network = lexicon, network

    def worst(self, data, offsets) -> np.ndarray:
        """The largest window logit of each row, -inf without words."""
        words = W.Words(data, offsets)
        out = np.full(len(offsets) - 1, -np.inf)
        if not len(words.start):
            return out
        _, at, number = np.unique(words.hashes(fold=True), return_index=True, return_inverse=True)
        hashes = words.hashes(fold=True)[at]
        x = self.lexicon.inputs(data, words.start[at], words.end[at], hashes)
        gates = {s: np.vstack([v, np.zeros((1, v.shape[1]), np.float32)]) for s, v in self.network.project(x).items()}
        number = np.append(number, len(at))
        table, row = _window_table(words.count, words.ptr[:-1], len(words.start))
        for low in range(0, len(row), 4096):
            part = table[low : low + 4096]
            keep = (part < len(words.start)).astype(np.float32)
            np.maximum.at(out, row[low : low + 4096], self.network.logits(gates, keep, number[part]))
        return out

    def score(self, data, offsets) -> np.ndarray:
        worst = self.worst(data, offsets)
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(self.network.scale * worst + self.network.shift)))
        return np.where(np.isfinite(worst), p, 0.0)


def _with_words(texts: list[str], labels: np.ndarray):
    """(bytes, words, their hashes, label) of each text that has words, one at a time, since together they are larger than the texts."""
    for text, label in zip(texts, labels):
        data = np.frombuffer(text.encode(), np.uint8)
        words = W.Words(data, np.array([0, len(data)]))
        if len(words.start):
            yield data, words, words.hashes(fold=True), label


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Model:
    """A model from texts and labels (1: toxic)."""
    lexicon, network = Lexicon(), Network(seed)
    labels = np.asarray(labels, np.int64)
    marks = []  # labels of the texts that have words
    for data, words, hashes, label in _with_words(texts, labels):
        marks.append(label)
        lexicon.texts[label] += 1
        np.add.at(lexicon.words[label], np.unique(_bucket(hashes)), 1)
        np.add.at(lexicon.parts[label], np.unique(_bucket(_word_parts(data, words.start, words.end)[0])), 1)
    if lexicon.texts.min() == 0:
        network.p["v"][:] = 0
        network.shift = 6.0 if lexicon.texts[1] else -6.0
        return Model(lexicon, network)
    xs, keeps, ys, owner = [], [], [], []
    for i, (data, words, hashes, label) in enumerate(_with_words(texts, labels)):
        x = lexicon.inputs(data, words.start, words.end, hashes, own=label)
        table, _ = _window_table(words.count, words.ptr[:-1], len(x))
        keep = table < len(x)
        x = np.vstack([x, np.zeros((1, INPUTS), np.float32)])[table]
        hint = np.sort(x[:, :, 0] + x[:, :, 1], axis=1)[:, -3:].sum(1)
        best = np.argsort(-hint, kind="stable")
        pick = best[:1] if label else np.unique(np.concatenate([best[:2], best[-1:]]))
        xs.append(x[pick])
        keeps.append(keep[pick])
        ys.append(np.full(len(pick), label))
        owner.append(np.full(len(pick), i))
    x, keep, y, owner = np.concatenate(xs), np.concatenate(keeps).astype(np.float32), np.concatenate(ys), np.concatenate(owner)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for low in range(0, len(y), BATCH):
            part = order[low : low + BATCH]
            step += 1
            for k, grad in network.gradients(x[part], keep[part], y[part], share[part]).items():
                grad = np.clip(grad, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad**2
                network.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    worst = np.full(len(marks), -np.inf)
    gates = {s: (x @ network.p["W" + s] + network.p["c" + s]).reshape(-1, 3 * HIDDEN) for s in "fb"}
    index = np.arange(len(x) * WINDOW).reshape(-1, WINDOW)
    for low in range(0, len(x), 4096):
        part = slice(low, low + 4096)
        np.maximum.at(worst, owner[part], network.logits(gates, keep[part], index[part]))
    network.scale, network.shift = _calibrated(worst, np.array(marks))
    return Model(lexicon, network)


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by logistic regression, by Newton's steps."""
    center, spread = logit.mean(), logit.std() + 1e-6
    x = np.column_stack([(logit - center) / spread, np.ones(len(y))])
    w = np.zeros(2)
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * w), -2, 2)
    scale = max(w[0] / spread, 1e-3)
    return float(scale), float(w[1] - w[0] * center / spread)


def is_held_out(id_col) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows that are not held out.

    Of each label, those with the least hash of the id, ``TOXIC_ROWS`` and
    ``CLEAN_ROWS`` at most, of texts of at most ``TRAIN_BYTES`` bytes.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.dropna().where(~is_held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    bounds = ((1, TOXIC_ROWS), (0, CLEAN_ROWS))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in bounds]
    picked = picked[0].unionAll(picked[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.where(F.octet_length("text") <= TRAIN_BYTES)
    rows = texts.join(F.broadcast(picked), "id").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("text", "ascending")])
    sample, marks = rows.column("text").to_pylist(), rows.column("label").to_numpy().copy()
    del rows
    try:
        return fit(sample, marks)
    finally:
        del sample
        give_back()  # the stages after it need the driver's memory


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column score, from 0 to 1; null and empty texts score 0.

    Every row gets its own score, so ids may be null or repeated; a column
    named score is replaced. An empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != "score"]
    out = docs.select(*(F.col(f"`{c}`") for c in columns))
    place = columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            marks = [held.value.score(data, offsets) for _, _, data, offsets in W.pieces(batch.column(place))]
            mark = np.concatenate(marks) if marks else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark, pa.float64())], names=[*columns, "score"])

    return out.mapInArrow(lean(run), out.withColumn("score", F.lit(0.0).cast("double")).schema)
