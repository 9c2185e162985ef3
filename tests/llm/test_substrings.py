"""Duplicate windows against a dictionary of all of them."""

import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import substrings


def brute(rows, size=35):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in words for i in range(len(w) - size + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, count):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((34, 35, 36, 50, 90, 200))]
    texts = []
    for _ in range(count):
        words = [f"w{rng.randrange(50_000)}" for _ in range(rng.choice([0, 3, 34, 35, 60, 200]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passages)
            a = rng.randrange(3)
            words[(at := rng.randint(0, len(words))) : at] = p[a : len(p) - rng.randrange(3)]
        texts.append(" ".join(words))
        if rng.random() < 0.1:
            texts.append(texts[rng.randrange(len(texts))])
        if rng.random() < 0.05:
            texts.append("same " * rng.choice([35, 36, 40, 100]))
    return texts


@pytest.mark.parametrize("light", [2_000, 3])
def test_equals_brute_force(spark, monkeypatch, light):
    monkeypatch.setattr(substrings, "LIGHT", light)
    rows = [*enumerate(corpus(11, 250)), (5000, None), (5001, ""), (7, "x y"), (None, " ".join(map(str, range(60)))), (None, " ".join(map(str, range(60)))), (8, "one " + " ".join(map(str, range(20, 60))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as cls", "'x' as kept").repartition(4)
    got = sorted((tuple(r) for r in substrings.substring_dedup(docs).collect()), key=str)
    assert got == brute(rows)


def test_one_document_repeats_itself(spark):
    w = [f"a{i}" for i in range(40)]
    rows = [(1, " ".join([*w, "between", *w])), (2, " ".join(w[:34]))]
    assert sorted(tuple(r) for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_empty(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_kept_texts(spark):
    rows = [*enumerate(corpus(3, 40)), (999, None), (3, "another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], len((r["text"] or "").split()), sum(s["to"] - s["from"] for s in r["spans"])) for r in substrings.kept_texts(docs).collect())
    assert got == sorted((d, n - gone, gone) for d, n, gone, _ in brute(rows))


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_and_parse(seed):
    """Of every place of a block against all other places, and the parse against the windows that repeat."""
    rng = random.Random(seed)
    parts = [[rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.choice([6, 7, 9, 12]))] for _ in range(30)]
    block = substrings.Reference([" ".join(p).encode() for p in parts], 6)
    longest = block.longest()
    starts = [(k, i) for k, p in enumerate(parts) for i in range(len(p) - 5)]

    def common(x, y):
        a, b = parts[x[0]][x[1] :], parts[y[0]][y[1] :]
        return next((n for n, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))

    for k, i in starts:
        assert longest[block.begin[k] + i] == max(common((k, i), o) for o in starts if o != (k, i))
    seen = Counter(tuple(p[i : i + 6]) for p in parts for i in range(len(p) - 5))
    for k, p in enumerate(parts):
        spans = substrings.parse(longest[block.begin[k] : block.begin[k] + len(p)], 6)
        covered = {j for a, b in spans for j in range(a, b)}
        assert covered == {j for i in range(len(p) - 5) if seen[tuple(p[i : i + 6])] > 1 for j in range(i, i + 6)}


def test_merged():
    import numpy as np

    assert substrings.merged(np.array([[5, 9], [0, 3], [3, 4], [6, 7], [20, 22]])).tolist() == [[0, 4], [5, 9], [20, 22]]


def test_null_and_repeated_ids_and_equal_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), (1, c + " " + b), (1, c + " " + b), (1, a + " x"), (2, "y " + c)] + [(None, f"{i} " + " ".join(f"{i}_{j}" for j in range(40))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in substrings.substring_dedup(docs).collect()), key=str) == brute(rows)
    got = sorted((str(r["doc_id"]), len((r["text"] or "").split())) for r in substrings.kept_texts(docs).collect())
    assert got == sorted((str(d), n - gone) for d, n, gone, _ in brute(rows))


def test_a_very_long_text(spark):
    long = [f"u{i}" for i in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[70_000:70_100])), (3, " ".join(long[5:40] + ["z"] + long[100:134]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.substring_dedup(docs).collect()) == brute(rows)


@pytest.mark.parametrize("held", [1, 90, 500_000])
def test_near_copies_send_each_window_once(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "LIGHT", 3)
    monkeypatch.setattr(substrings, "HELD_WINDOWS", held)
    monkeypatch.setattr(substrings, "TASK_ROWS", 100)
    base = [f"w{i}" for i in range(120)]
    rows = [(m, " ".join([*base[: m % 7 * 15], f"own{m}", *base[m % 7 * 15 :]])) for m in range(60)] + [(100, " ".join(base)), (101, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in substrings.substring_dedup(docs).collect()), key=str) == brute(rows)
    found = spark.createDataFrame([(m, 1, list(range(80)), list(range(80)), [1] * 80) for m in range(60)], "cls long, copies long, heavy_at array<int>, heavy array<long>, heavy_times array<int>").coalesce(1)
    sent = substrings.combined(found, 4, substrings.WINDOW).selectExpr("part", "size(print) AS n").collect()
    if held == 500_000:  # all in one go: 80 different windows, and a span for each text
        assert (sum(r["n"] for r in sent if r["part"] >= 0), sum(r["n"] for r in sent if r["part"] < 0)) == (80, 60)
