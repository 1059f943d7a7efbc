"""No link between different texts is lost: groups of texts near the threshold."""

import random

import pytest

pytest.importorskip("breezeline.llm")
from breezeline.llm import _graph, near_copies


def shingles(words):
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def changed(rng, words, more):
    """A copy with a run of new words in the middle; up to ``more`` = 0 the similarity is 0.8 or above."""
    out, n = list(words), max(1, (len(words) - 3) // 9 - 3 + more)
    at = rng.randrange(5, len(words) - n - 5)
    out[at : at + n] = [f"n{rng.randrange(10**9)}" for _ in range(n)]
    return out


def groups(seed, count, size):
    """Groups with links just above the threshold beside pairs just below it."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [f"w{rng.randrange(10**7)}" for _ in range(size)]
        rows.append(base)
        for more in (-1, 0, 0, 1, 1, 2, 3):
            rows.append(changed(rng, base, more))
        rows.append(changed(rng, rows[-1], 0))
    return [" ".join(w) for w in rows]


def brute(texts, near):
    """Smallest place reachable; ``near`` says which pairs can share anything."""
    sets = [shingles(t.split()) for t in texts]
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    links = 0
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * len(sets[i] | sets[j]):
            links += 1
            a, b = sorted((root(i), root(j)))
            name[b] = a
    return [root(i) for i in range(len(texts))], links


@pytest.mark.parametrize("size", [60, 400])
def test_no_link_near_the_threshold_is_lost(spark, size):
    count, each = 150, 9
    texts = groups(size, count, size)
    near = [(g * each + i, g * each + j) for g in range(count) for j in range(each) for i in range(j)]
    want, links = brute(texts, near)
    assert links > count
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_chain_of_copies_under_one_leader(spark):
    """Each text is linked with the next one only, while many share a bucket."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(80):
        texts.append(" ".join(words))
        words = changed(rng, words, -8)
    near = [(i, j) for j in range(80) for i in range(j)]
    want, _ = brute(texts, near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert [got[i] for i in range(80)] == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_both_ways(spark, monkeypatch, one_task):
    monkeypatch.setattr(_graph, "ONE_TASK", one_task)
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    name = {n: n for pair in links for n in pair}
    for _ in links:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    looped = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in name.items() if n not in looped}
