"""The join against all pairs."""

import random

import numpy as np
import pytest

from tessera.llm import ngram_join


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, count, vocabulary=4000):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    while len(texts) < count:
        kind = rng.random()
        if kind < 0.5 or not texts:
            words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 3, 5, 8, 40, 120, 300]))]
            if kind < 0.2:
                words[len(words) // 2 : len(words) // 2] = passage
        else:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 6, 10])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.choice([0, 1, 3])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1])
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("family", [1200, 12])
def test_equals_all_pairs(spark, family):
    texts = [*corpus(5, 350), "", None, "A b C", "a B c", "a b"]
    rows = [(1000 - i if i % 2 else i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as cls", "3 as component_id").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.ngram_join(docs, family=family).collect())
    assert got == brute(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (7, "q r s"), (3, None), (None, "z z z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.ngram_join(docs).collect()), key=str)
    assert got == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (7, 1, 7), (3, 0, 3), (None, 1, None), (None, 0, None)], key=str)
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = [rng.choice(400, rng.integers(4, 60), replace=False) for _ in range(4)]
        sets = []
        for _ in range(30):
            s = set(base[rng.integers(4)].tolist())
            s = {x for x in s if rng.random() > 0.08} | set(rng.choice(400, rng.integers(0, 4)).tolist())
            if s:
                sets.append(np.array(sorted(s), np.uint64))
        sizes = np.array([len(s) for s in sets])
        got = ngram_join.linked(np.arange(len(sets)), np.arange(len(sets)), sizes, sets)
        up = {}

        def find(x, up=up):
            while x in up:
                x = up[x]
            return x

        for a, b in got:
            inter = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            assert 7 * inter >= 3 * (sizes[a] + sizes[b])
            if find(a) != find(b):
                up[find(a)] = find(b)
        for a in range(len(sets)):
            for b in range(a):
                inter = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if 100 * inter >= 75 * (sizes[a] + sizes[b] - inter):
                    assert find(a) == find(b)
