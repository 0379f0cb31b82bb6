"""Benchmark passages with repeated shingles near the similarity limit, against brute force."""

import random
from collections import Counter

import pytest

from setlist.llm import decontaminate as dc


def shingles(words):
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def best(doc, item):
    """Greatest weighted similarity of the item with any window of its size, and where it first is."""
    own, theirs = shingles(item.split()), shingles(doc.split())
    n = len(own)
    found = [(similarity(theirs[i:i + n], own), -i) for i in range(max(1, len(theirs) - n + 1))]
    value, at = max(found)
    return value, -at


def searched(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id int, text string, block int")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id int, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.find_leaks(d, b).collect()}


def check(spark, docs, items, least=1.0):
    got = searched(spark, docs, items)
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            value, at = best(d, t)
            if value >= 0.8:
                want[i, j] = value, at
    assert set(got) <= set(want) and len(got) >= least * len(want)
    for key, r in got.items():
        own, theirs = shingles(items[key[1]].split()), shingles(docs[key[0]].split())
        assert r["similarity"] == pytest.approx(want[key][0]) and 0 <= r["hamming"] <= 24
        # of windows that are equally similar any may be named
        assert similarity(theirs[r["start"]:r["start"] + len(own)], own) == pytest.approx(want[key][0])
        # as many words as the item has, or the whole document if it is shorter
        assert r["n_words"] == min(len(items[key[1]].split()), len(docs[key[0]].split()))
    return want


def test_one_side_repeats_a_shingle(spark):
    """178 shingles in common, one shingle 22 times in the window only: similarity 0.80, far apart by count-weighted prints."""
    rng = random.Random(2)
    docs, items = [], []
    for k in range(12):
        words = [f"w{k}x{i}x{rng.randrange(10**6)}" for i in range(204)]
        items.append(" ".join(words))
        docs.append(" ".join(words[:182] + ["same"] * 22))
    want = check(spark, docs, items)
    assert len(want) == 12 and all(0.8 <= v < 0.83 for v, _ in want.values())


def test_both_sides_repeat_a_passage(spark):
    """One shingle 150 times on both sides and other words around it: far apart by prints of distinct shingles."""
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    items = [" ".join([f"hot{k}"] * 154 + fresh(12)) for k in range(8)]
    docs = [" ".join([f"hot{k}"] * 154 + fresh(12)) for k in range(8)]
    assert len(check(spark, docs, items)) == 8


def test_random_edits_around_the_limit(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(40)]
    items, docs = [], []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 80))]
        at = rng.randrange(len(words) - 8)
        words[at:at] = words[at:at + 8] * rng.randrange(0, 3)  # some passages repeat
        items.append(" ".join(words))
        edited = list(words)
        for _ in range(rng.randrange(0, 3)):
            edited[rng.randrange(len(edited))] = "odd"
        docs.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))] + edited + ["end"] * rng.randrange(0, 9)))
    assert len(check(spark, docs, items)) >= 12


def test_documents_shorter_than_the_item(spark):
    words = [f"s{i}" for i in range(60)]
    assert set(check(spark, [" ".join(words[:52]), " ".join(words[:40]), "s1 s2", ""], [" ".join(words)])) == {(0, 0)}
