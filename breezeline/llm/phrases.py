"""Phrase collocations: frequent n-grams from mergeable Misra-Gries summaries, then exact counts.

First pass: map tasks count the hashed n-grams of their texts and send them to
hash partitions. Each partition folds what arrives into a Misra-Gries summary of
more counters than its mass divided by the threshold, so that every n-gram that
reaches the threshold survives, whatever else is dropped; two equal hashes only
let more survive. Survivors set bits of a filter of fixed size.

Second pass: the n-grams that the filter lets through are counted exactly, as
text. The filter has ``_filter.BITS`` whatever the input, so it may be broadcast;
the more n-grams are frequent, the more infrequent ones it lets through, which
costs time and changes no result, since the exact counts decide.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _filter
from . import _words as W
from ._graph import landed

LONGEST = 4  # words of a phrase
SPARE = 8  # counters of a summary, as a multiple of mass / threshold
PART_BYTES = 8 << 20  # text whose n-grams meet in one hash partition
LEAST_PARTS = 16
FLUSH_BYTES = 6 << 20  # text counted before a message is sent
CHUNK = 1 << 20  # entries that are merged into a summary at once
SALTS = 64  # of the first cut of a ranking

_CUT = np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_BETWEEN = _CUT.copy()
_BETWEEN[[32, 9]] = True
MESSAGE = "part long, ones binary, keys binary, counts binary"
COUNTED = "lang string, words int, phrase string, f long"


def _grams(langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
    """The words, each one's language number, the languages, and for n = 1.. the n-grams' first words and hashes."""
    words = W.Words(W.FOLD[data], offsets, _BETWEEN)
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    lang = coded.indices.to_numpy().astype(np.int64)[words.row_of_word()]
    salt = np.array([int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little") for n in names] or [0], np.uint64)
    hashes = words.hashes()
    piece = np.cumsum(_CUT[data])[words.start] if len(words.start) else words.start
    row = words.row_of_word()
    joined = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    grams, ok = [], np.ones(len(hashes), bool)
    for n in range(1, LONGEST + 1):
        if n > 1:
            ok = ok[:-1] & joined[n - 2 :]
        first = np.flatnonzero(ok)
        grams.append((first, W.mix(W.windows(hashes, n)[first] ^ (salt[lang[first]] + np.uint64(n)))))
    return words, lang, names, grams


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _pieces(batches):
    for batch in batches:
        langs = batch.column(0).fill_null("und")
        for low, high, data, offsets in W.pieces(batch.column(1)):
            yield langs.slice(low, high - low), data, offsets


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partitions follow one another in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _sender(parts: int):
    def message(hashes):
        hashes.sort()
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(hashes))).astype(np.uint32)
        names, at = np.unique(_part(hashes[first], parts), return_index=True)
        keys = hashes[first].astype(np.uint32)
        rows = []
        for name, k, c in zip(names.tolist(), np.split(keys, at[1:]), np.split(counts, at[1:])):
            one = c == 1
            rows.append((name, k[one].tobytes(), k[~one].tobytes(), c[~one].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in MESSAGE.split(", ")]
        )

    def run(batches):
        held, size = [], 0
        for langs, data, offsets in _pieces(batches):
            held += [hashes for _, hashes in _grams(langs, data, offsets)[3]]
            size += len(data)
            if size >= FLUSH_BYTES:
                yield message(np.concatenate(held))
                held, size = [], 0
        if held:
            yield message(np.concatenate(held))

    return run


class Summary:
    """Misra-Gries counters of uint32 keys; no key's count is short by more than ``missed``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts, self.missed = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts, of another summary or of single keys; then the smallest give way until all fit."""
        self.keys, self.counts = _summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        over = len(self.keys) - self.capacity
        if over > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.counts -= cut
            held = self.counts > 0
            self.keys, self.counts = self.keys[held], self.counts[held]
            self.missed += cut

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key that may have been added ``threshold`` times."""
        return self.keys[self.counts + self.missed >= threshold]


def _named(part, keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64) ^ (np.asarray(part).astype(np.uint64) << np.uint64(32))


def _summary(threshold: int, filter_size: int):
    def run(table):
        columns = {n: table.column(n).to_pylist() for n in ("part", "ones", "keys", "counts")}
        sent = [np.frombuffer(c, np.uint32) for c in columns["counts"]]
        mass = sum(len(o) // 4 for o in columns["ones"]) + sum(int(c.sum(dtype=np.int64)) for c in sent)
        summary = Summary(SPARE * mass // threshold + 1)
        keys, counts, held = [], [], 0
        for i, (ones, more, c) in enumerate(zip(columns["ones"], columns["keys"], sent)):
            ones = np.frombuffer(ones, np.uint32)
            keys += [ones, np.frombuffer(more, np.uint32)]
            counts += [np.ones(len(ones), np.int64), c.astype(np.int64)]
            held += len(ones) + len(c)
            if held >= CHUNK or i == len(sent) - 1:
                summary.merge(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [], [], 0
        found = _named(columns["part"][0], summary.survivors(threshold))
        return pa.table({"place": _filter.places(found, filter_size)})

    return run


def _counter(parts: int, filter_bits):
    def run(batches):
        bits = np.frombuffer(filter_bits.value, np.uint8)
        for langs, data, offsets in _pieces(batches):
            words, lang, names, grams = _grams(langs, data, offsets)
            codes, distinct = words.codes()
            texts = np.array(distinct.to_pylist() or [b""], object)
            width = len(texts)
            rows = [(names[i], 0, b"", n) for i, n in enumerate(np.bincount(lang, minlength=len(names)).tolist())]
            for n, (first, hashes) in enumerate(grams, 1):
                first = first[_filter.holds(bits, _named(_part(hashes, parts), hashes.astype(np.uint32)))]
                kind = lang[first]
                for j in range(n):  # numbers of equal beginnings, exactly
                    _, at, kind, times = np.unique(
                        kind * width + codes[first + j], return_index=True, return_inverse=True, return_counts=True
                    )
                if len(first):
                    spots = first[at]
                    spelled = texts[codes[spots[:, None] + np.arange(n)]]
                    langs_of = lang[spots].tolist()
                    rows += [(names[x], n, b" ".join(w), t) for x, w, t in zip(langs_of, spelled.tolist(), times.tolist())]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "phrase", "f"])

    return run


def frequent_phrases(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", threshold: int = 30, filter_size: int = _filter.BITS
) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``LONGEST`` words with f >= ``threshold``.

    Rows with words = 0 hold the number of all words of a language. A-Z count as a-z; phrases do
    not go across line ends or any of .,;:!? and words are what blanks part. A null language
    counts as ``und``; null and empty texts have no words; a repeated row counts each time; other
    columns are ignored; an empty table gives an empty result.
    """
    if threshold < 1 or filter_size % (8 * 4096):
        raise ValueError("the threshold must be positive, the filter whole bitmaps of 4 KB")
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / PART_BYTES))
    sent = texts.mapInArrow(_sender(parts), MESSAGE)
    places = sent.groupBy("part").applyInArrow(_summary(threshold, filter_size), "place long")
    filter_bits = spark.sparkContext.broadcast(_filter.gathered(places, filter_size))
    counted = texts.mapInArrow(_counter(parts, filter_bits), COUNTED)
    total = counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return landed(total.where((F.col("words") == 0) | (F.col("f") >= threshold)))


def collocations(counts: DataFrame, top: int = 2000, percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two words or more.

    ``counts`` is the result of ``frequent_phrases``. A phrase is cut where floor(2000000 * a / (l + r))
    is least, at the earliest such place; one that lies in a longer phrase of at least ``percent``
    per cent of its occurrences is left out. Ties go to the more frequent, then by bytes.
    """
    f = F.col("f").cast("decimal(38,0)")
    long = counts.where("words >= 2")
    cuts = long.select("lang", "words", "phrase", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    part = counts.where("words between 1 and 3")
    first = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(2000000 * cast(f as decimal(38,0))) div (cast(l as decimal(38,0)) + r)")
    cut = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    worst = cut.groupBy("lang", "words", "phrase", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # a longer phrase that holds one is at most as frequent as one that is a word longer
    longer = long.where("words >= 3").select(
        "lang", "f",
        F.expr("explode(array(substring_index(phrase, ' ', words - 1), substring_index(phrase, ' ', 1 - words)))").alias("phrase"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = worst.join(longer, ["lang", "phrase"], "left")
    kept = held.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < percent * f))
    order = [F.desc("cut.score"), F.desc("f"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    few = salted.where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(n, "lang").select(
        "lang", "rank", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"
    )
