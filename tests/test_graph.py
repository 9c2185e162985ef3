"""Closures by doubled distances and mentions by automata, against plain walks."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph

EDGES = "repo string, source_path string, target_path string"


def plain(edges, targets):
    near = {}
    for repo, s, t in edges:
        near.setdefault((repo, t), set()).add(s)
    out = []
    for repo, target in targets:
        depth, queue = {}, deque([(target, 0)])
        while queue:
            at, d = queue.popleft()
            for s in near.get((repo, at), ()):
                if s not in depth and (s != target or d == 0):
                    depth[s] = d + 1
                    queue.append((s, d + 1))
        out += [(repo, target, s, d) for s, d in depth.items()]
    return sorted(out)


def same(spark, edges, targets):
    got = graph.dependents(spark.createDataFrame(edges, EDGES), spark.createDataFrame(targets, "repo string, target string"))
    assert sorted(map(tuple, got.select("repo", "target", "path", "depth").collect())) == plain(edges, targets)


def made(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"r{rng.randrange(2)}", f"f{rng.randrange(n)}", f"f{rng.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_of_all_and_of_some(spark, seed):
    edges = made(seed, 25, 45)
    every = sorted({(r, p) for r, *ends in edges for p in ends}) + [("r0", "unknown"), ("none", "f1")]
    same(spark, edges, every)
    same(spark, edges, every[:4])


def test_cycles_and_self_edges(spark):
    edges = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "d", "c"), ("r", "d", "d"), ("r", "e", "d")]
    same(spark, edges, [("r", p) for p in "abcde"])
    same(spark, [], [("r", "a")])


def test_long_chain(spark, monkeypatch):
    """3,000 files in a row, of which a few are asked for: no round a file, and no limit on depth."""
    n = 3000
    edges = spark.range(n - 1).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("id") + 1).alias("source_path"), F.concat(F.lit("f"), F.col("id")).alias("target_path"))
    rounds = []
    monkeypatch.setattr(graph, "stored", lambda df, name, kept=graph.stored: rounds.append(name) or kept(df, name))
    got = graph.dependents(edges, spark.createDataFrame([("r", "f0"), ("r", "f2998"), ("r", "f2999")], "repo string, target string"))
    counts = {r["target"]: (r["n"], r["far"]) for r in got.groupBy("target").agg(F.count("*").alias("n"), F.max("depth").alias("far")).collect()}
    assert counts == {"f0": (2999, 2999), "f2998": (1, 1)}
    assert len(rounds) < 3 + graph.SHALLOW + 2 + 14


def test_mentions(spark):
    rng = random.Random(5)
    names = [("r", n) for n in ["get", "get_all", "all", "é", "x.y", "a b", "zz"]] + [("s", "get"), ("s", "only")]
    bodies = [(rng.choice("rst"), f"p{i}", " ".join(rng.choices(["get_all(", "get", "ball", "é", "x.y", "a b", "nothing", "only"], k=4))) for i in range(40)] + [("r", "null", None), ("r", "empty", "")]
    frames = spark.createDataFrame(bodies, "repo string, path string, content string"), spark.createDataFrame(names + names[:2], "repo string, name string")
    want = sorted((r, p, n) for r, p, c in bodies for r2, n in names if r == r2 and n in (c or ""))
    for limits in ({}, {"body_bytes": 100, "name_bytes": 40}):
        assert sorted(map(tuple, graph.mentions(*frames, **limits).collect())) == want
    assert graph.mentions(frames[0].limit(0), frames[1]).count() == graph.mentions(frames[0], frames[1].limit(0)).count() == 0
