"""Phrase collocations against brute force, and what the summaries promise."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("breezeline.llm")
from breezeline.llm import phrases


def brute(rows, threshold, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        of = counts.setdefault(lang, Counter())
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                of.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, of in counts.items():
        found = []
        for phrase, a in of.items():
            if len(phrase) < 2 or a < threshold:
                continue
            cuts = [(2000000 * a // (of[phrase[:k]] + of[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = (
                f for p, f in of.items() if len(p) > len(phrase) and f >= threshold
                and any(p[i : i + len(phrase)] == phrase for i in range(len(p) - len(phrase) + 1))
            )
            if any(100 * f >= 80 * a for f in longer):
                continue
            found.append((-score, -a, " ".join(phrase).encode(), of[phrase[:k]], of[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(seed=2, count=400):
    rng = random.Random(seed)
    words = ["a", "B", "ça", "dd", "New", "york", "the", "of", "x\x01", "Ä"] + [f"r{i}" for i in range(60)]
    rows = [(None, None), ("en", ""), ("en", " . \t"), ("und", "New York " * 40), ("de", "a")]
    for _ in range(count):
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(words[: rng.choice([4, 10, 70])]))
            if rng.random() < 0.3:
                out.append("new york" if rng.random() < 0.5 else "of the New York")
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for w in out)
        rows.append((rng.choice(["en", "en", "fr", None]), text))
    return rows


@pytest.mark.parametrize("threshold,top", [(30, 2000), (5, 40), (1, 10)])
def test_against_brute_force(spark, threshold, top):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, f int")
    counts = phrases.frequent_phrases(docs, threshold=threshold)
    got = [tuple(r) for r in phrases.collocations(counts, top=top).collect()]
    assert sorted(got) == brute(rows, threshold, top)


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(4)
    keys = np.concatenate([rng.integers(0, 50000, 60000), np.repeat(np.arange(90000, 90040), 30), np.repeat(99999, 20000)])
    rng.shuffle(keys)
    threshold, mass = 30, len(keys)
    for spare in (1, 8):
        parts = []
        for chunk in np.array_split(keys.astype(np.uint32), 7):  # summaries of parts, merged
            one = phrases.Summary(spare * mass // threshold + 1)
            one.merge(*phrases._summed(chunk, np.ones(len(chunk), np.int64)))
            parts.append(one)
        whole = phrases.Summary(spare * mass // threshold + 1)
        for one in parts:
            whole.merge(one.keys, one.counts)
            whole.missed += one.missed
        values, counts = np.unique(keys, return_counts=True)
        assert set(values[counts >= threshold]) <= set(whole.survivors(threshold).tolist())
        assert len(whole.keys) <= whole.capacity and whole.missed <= mass // whole.capacity + 7


def test_full_filter_changes_nothing(spark):
    rows = rows_of(seed=9, count=120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in phrases.collocations(phrases.frequent_phrases(docs, threshold=3, filter_size=1 << 15)).collect()]
    assert sorted(got) == brute(rows, 3, 2000)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(phrases.frequent_phrases(docs)).collect() == []
