"""Repeats by the bitmap and by the join, and on words whose patterns cancel out in weak hashes."""

import random

import pytest

pytest.importorskip("breezeline.llm")
import numpy as np

from breezeline.llm import _words as W
from breezeline.llm import near_copies, quality, repeats


def thue_morse(length):
    out = "a"
    while len(out) < length:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def removed(texts, length):
    seen, out = {}, []
    for i, text in enumerate(texts):
        w = text.split()
        gone = set()
        for p in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[p : p + length]), i) < i:
                gone.update(range(p, p + length))
        out.append(" ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("length", [13, 30])
@pytest.mark.parametrize("filter_size", [1 << 15, 1 << 22])  # one that is full, one that is not
def test_against_brute_force(spark, length, filter_size):
    rng = random.Random(length)
    words = [f"w{i}" for i in range(3000)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(5, 70))] for _ in range(12)]
    texts = []
    for _ in range(300):
        out = []
        for _ in range(rng.randrange(8)):
            out += rng.choice(shared) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(150))]
        texts.append(" ".join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.without_repeats(docs, length=length, filter_size=filter_size).collect()
    want = removed(texts, length)
    assert sum(len(w) for w in want) < sum(len(t) for t in texts)
    assert {r["doc_id"]: r["kept_text"] for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("length", [1024, 4096])
def test_words_whose_patterns_cancel_out(spark, length):
    one = thue_morse(length)
    other = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    texts = [f"{one} {rest}", f"{other} {rest}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_removed"] for r in repeats.without_repeats(docs).collect()] == [0, 0]
    got = near_copies.near_copies(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1, 2}
    twice = spark.createDataFrame([(1, f"{one} x y {other} x y " + rest)], "doc_id long, text string")
    assert quality.judge(twice, quality.Forest(0.0)).first()["n_repeat_words"] == 0


def test_hashes_of_two_keys_and_of_long_words():
    words = [thue_morse(n) for n in (1, 8, 63, 64, 65, 128, 1024)] + ["x" * 64, "x" * 65, "x" * 65 + "y", "a\0", "a"]
    text = " ".join(words).encode()
    found = W.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for key in (0, 1):
        assert len(set(found.hashes(key=key).tolist())) == len(set(words))
    assert not set(found.hashes().tolist()) & set(found.hashes(key=1).tolist())
    assert (found.hashes(fold=True) == found.hashes()).all()
