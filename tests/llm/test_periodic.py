"""Periodic runs against brute force, through the operator and the named query."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("breezeline.llm")
import numpy as np

from breezeline.llm import _words as W
from breezeline.llm import periodic, queries


def brute(words):
    """(start, length, period) of all runs, by start, then period."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                run = words[i : j + q]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed=3, count=60):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "A a " * 9, "x\x0by " * 4, "é è " * 700 + "é", ("a " * 50 + "b ") * 40]
    for _ in range(count):
        k, words = rng.choice([1, 2, 3, 6]), []
        for _ in range(rng.randrange(1, 4)):
            base = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randrange(1, 30))]
            words += (base * rng.randrange(1, 9))[: rng.randrange(1, 160)] + rng.choices("abxyz", k=rng.randrange(3))
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    letters = "a"
    for _ in range(12):
        letters += letters.translate(str.maketrans("ab", "ba"))
    out.append(f"{letters} {letters.translate(str.maketrans('ab', 'ba'))} " * 3)
    return out


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_and_collapsed_texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    rows += [(None, "b b b b b b", None, None), rows[8], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string")
    got = periodic.collapse_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert [tuple(x) for x in r["runs"]] == [(0, 6, 1)] and r["collapsed"] == "b"
            continue
        words = split(texts()[r["doc_id"]])
        want = brute(words)
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words)
        assert r["collapsed"] == collapsed(words, want)
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert periodic.collapse_runs(named).where("doc_id = '8'").count() == 2


@pytest.mark.parametrize("text", ["a " * 100000, ("a " * 100 + "b ") * 500, " ".join(str(i % 5000) for i in range(40000))])
def test_very_long_texts(text):
    data = text.encode()
    got = periodic.runs_of_words(W.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
    words = len(text.split())
    periods = {"a " * 100000: {1}, ("a " * 100 + "b ") * 500: {1, 101}}.get(text, {5000})
    assert {q for _, _, q in got} == periods
    assert (0, words, max(periods)) in got


def test_window_by_window(monkeypatch):
    monkeypatch.setattr(periodic, "WIDEST", 4)
    for text in texts(seed=8, count=40)[3:]:
        data = text.encode()
        got = periodic.runs_of_words(W.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        assert sorted((a, b - a, q) for a, b, q in got) == sorted(brute(split(text)))


def test_products_are_exact():
    rng = np.random.default_rng(1)
    f, g = rng.integers(0, 5000, (3, 16)), rng.integers(0, 5000, (3, 31))
    want = np.array([[(a * b[t : t + 16]).sum() for t in range(16)] for a, b in zip(f, g)])
    for p, root in periodic.PRIMES:
        assert (periodic.products(f.astype(np.uint64), g.astype(np.uint64), p, root) == want % p).all()


def test_query(spark, tmp_path):
    rows = [(i * 37 - 500, t) for i, t in enumerate(texts(seed=4, count=150))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for doc_id, text in rows:
        words = split(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g, a = h // 10, h // 10 % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        runs, r = brute(words), got[doc_id]
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        assert r["n_runs"] == len(runs)
        if best is None:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
        else:
            assert (r["start"], r["length"], r["period"]) == (best[1], -best[0], best[2])
            assert r["exponent_milli"] == 1000 * -best[0] // best[2]
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert changed > 5
