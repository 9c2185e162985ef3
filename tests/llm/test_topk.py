"""Histogram selection against sorting all scores."""

import random

import pytest

from tessera.llm import topk


def brute(rows, queries, k):
    def ints(v):
        import math

        if v is None or any(x is None or not math.isfinite(x) for x in v) or not v:
            return None
        return [math.floor(1024 * x) for x in v]

    usable = [(i, ints(v)) for i, v in rows if ints(v) is not None]
    out = []
    for q, v in queries:
        if (w := ints(v)) is None:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(w, x)), i) for i, x in usable if i != q and len(x) == len(w)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "ties", "huge", "few"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(3)
    n = 7 if kind == "few" else 600
    value = {"random": lambda: rng.gauss(0, 1), "ties": lambda: rng.choice([0.0, 0.5]) if rng.random() < 0.02 else 0.25, "huge": lambda: rng.gauss(0, 1) * 2e5, "few": rng.random}[kind]
    rows = [(i, [float("%.6g" % value()) for _ in range(4)]) for i in range(n)]
    if kind == "random":
        rows += [(n, None), (n + 1, [1.0, None, 0.0, 0.0]), (n + 2, [float("nan")] * 4), (n + 3, [float("inf"), 0.0, 0.0, 0.0]), (n + 4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as rank", "'x' as score").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 100 = 0 or vec_id > 598"), k=10, bins=16, block_size=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] % 100 == 0 or r[0] > 598], 10)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_large_components(spark):
    """Every finite vector takes part: components may be beyond 64 bits, if the products aren't; bounds aren't products."""
    rows = [(0, [1.0, 1.0]), (1, [2.0**42, 0.0]), (2, [2.0**40, 1.0]), (3, [0.5, 2.0]), (4, [1e13, -1e13]), (5, [0.0, 0.0]), (6, [-1e300, 1e300]), (7, [7e12, 7.0]), (100, [0.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id not in (6)"), df.where("vec_id in (0, 100)"), k=9)
    assert sorted(map(tuple, got.collect())) == brute([r for r in rows if r[0] != 6], [rows[0], rows[-1]], 9)
    flat = spark.createDataFrame([(0, [0.0, 5.0]), (1, [1e300, 2.0]), (2, [-3.5e305, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(flat, flat.where("vec_id = 0"), k=2).collect()] == [(0, 1, 1, 5120 * 2048), (0, 2, 2, 0)]
    alone = flat.where("vec_id < 2")  # the square of 1 doesn't fit, but it doesn't meet itself
    assert [tuple(r) for r in topk.top_k(alone, alone.where("vec_id = 1"), k=5).collect()] == [(1, 1, 0, 5120 * 2048)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(flat, flat.where("vec_id > 0"), k=5).collect()


def test_products_that_fit_though_their_bound_does_not(spark):
    rows = [(i, [2.0**41 if j == i else 0.0 for j in range(4)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df, k=3).collect())) == brute(rows, rows, 3)
    wide = spark.createDataFrame([(i, [2.0**41] * 2) for i in range(2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(wide, wide).collect()


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0]), (1, [2.0]), (1, [2.0]), (2, [3.0]), (None, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id = 2 or vec_id is null"), k=2).collect()))
    assert got == [(2, 1, 1, 3072 * 2048), (2, 2, 1, 3072 * 2048)]
