"""Mixing: quotas, flow and selection against direct computation."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def test_quotas_share_the_excess():
    assert mixing.quotas({"a": 10, "b": 1, "c": 100}, {"a": 1, "b": 2, "c": 3}, 111) == {"a": 27.0, "b": 3.0, "c": 81.0}
    assert mixing.quotas({"a": 0}, {"a": 1}, 0) == {"a": 0.0}
    capped = mixing.quotas({"a": 1, "b": 1, "c": 1000}, {"a": 1, "b": 2, "c": 3}, 1002)
    assert capped == {"a": 3.0, "b": 3.0, "c": 996.0}


def test_flow_is_of_least_cost():
    """All ways to route a tiny instance."""
    patterns = [(frozenset("a"), 2), (frozenset("ab"), 3), (frozenset("b"), 1)]
    targets = {"a": 4.0, "b": 5.0}
    cost = lambda f, size: sum(min(max(f - r * size, 0), size) * r * r for r in range(3))
    best = None
    for x, y, z, share in itertools.product(range(7), range(10), range(4), range(10)):
        if share <= y and x + share <= 4 and z + y - share <= 5:
            got = (-(x + y + z), cost(x, 2) + cost(y, 3) + cost(z, 1))
            best = min(best, got) if best else got
    flow = mixing.route(patterns, targets)
    assert (-sum(flow), sum(cost(f, s) for f, (_, s) in zip(flow, patterns, strict=True))) == best


def test_mix_of_documents(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(3000)] + [(None, None, "a"), (5, "x y\x0bz", "a"), (5, "x y\x0bz", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as pattern", "3 as copies").repartition(3)
    out = mixing.mix(docs, size=mixing.words_of(F.col("text")))
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got) == sorted((d if d is not None else -1, len((t or "").encode().split())) for d, t, _ in rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = r["sources"][0]
        assert 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
        size[s] += r["size"]
        target[s] = (r["target"], r["source_size"])
    weights = mixing.default_weights(list(size))
    assert weights == {"a": 1, "b": 2, "é": 3, None: 1}
    want = mixing.quotas(size, weights, sum(size.values()))
    for s in size:
        assert target[s] == (want[s], size[s])
        assert abs(taken[s] - want[s]) <= 41
    again = mixing.mix(docs.repartition(7), size=mixing.words_of(F.col("text"))).collect()
    key = lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, again)) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["copies"]) for r in got)


def test_overlapping_and_empty(spark):
    rows = [(i, 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, of array<string>")
    out = mixing.mix(docs, F.col("of"), F.col("n"), {"a": 1.0, "b": 1.0}, total=1000)
    assert out.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 1000
    assert mixing.mix(docs.limit(0), F.col("of"), F.col("n")).count() == 0


def test_each_group_of_patterns_has_its_flow(monkeypatch):
    rng = random.Random(2)
    patterns = [(frozenset([f"s{i}"]), rng.randrange(50)) for i in range(40)]
    sizes = {next(iter(m)): n for m, n in patterns}
    targets = mixing.quotas(sizes, mixing.default_weights(list(sizes)), sum(sizes.values()))
    runs, flow = [], mixing.flow
    monkeypatch.setattr(mixing, "flow", lambda own, *rest: runs.append(len(own)) or flow(own, *rest))
    assert mixing.route(patterns, targets) == [min(round(targets[s]), 3 * n) for s, n in sizes.items()] and runs == [1] * 40
    # Groups don't change what one flow over all patterns gives.
    chained = [*patterns, *((frozenset([f"s{i}", f"s{i + 1}"]), rng.randrange(90)) for i in range(0, 12, 3)), (frozenset(["s3", "s30"]), 17)]
    runs.clear()
    words = mixing.route(chained, targets)
    assert sorted(runs) == [1] * 31 + [3] * 3 + [5] and sum(words) == sum(flow(chained, targets))
    price = lambda given: sum(min(max(f - r * n, 0), n) * r * r for f, (_, n) in zip(given, chained, strict=True) for r in range(3))
    assert price(words) == price(flow(chained, targets))


def test_the_query_runs_the_flow(spark, monkeypatch):
    from tessera.llm.queries import QUERIES

    runs, flow = [], mixing.flow
    monkeypatch.setattr(mixing, "flow", lambda own, *rest: runs.append(flow(own, *rest)) or runs[-1])
    rows = QUERIES["op7_mixing"](spark, "/root/testdata/sf0.001").collect()
    target = {r["target"] for r in rows}
    assert sum(map(sum, runs)) > 0 and len(runs) >= len(target)


def test_more_sources_than_a_flow_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATTERNS", 20)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('host', cast(id % 60 AS string)) AS source", "'a b c d e' AS text")
    out = mixing.mix(docs)
    assert out.count() == 300 and abs(out.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] - 1500) <= 60 * 5
    with pytest.raises(ValueError, match="more than 20"):
        mixing.mix(docs.selectExpr("*", "array(source, 'other') AS of"), F.col("of"))


def test_ties_a_long_text_and_order(spark):
    rows = [(None, "w " * 200_000, "a")] + [(None, "x y", "a")] * 40 + [(None, "x y", "b")] * 40 + [(7, "", "b"), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: (r["doc_id"] is None, r["size"], str(r["sources"]), r["copies"])
    with_sources = lambda d: mixing.mix(d, keep=("doc_id",)).collect()
    one = sorted(map(key, with_sources(docs)))
    assert one == sorted(map(key, with_sources(docs.orderBy(F.desc("source")))))
    assert {c for _, size, s, c in one if size == 2 and "a" in s} <= {0, 1}


@pytest.mark.parametrize("run", [10_000, 3])
def test_rows_without_id_come_near_the_target(spark, monkeypatch, run):
    """Equal rows are taken one by one, whatever their number, and others of the same hash by their columns."""
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(None, "x y", "a", "en")] * 40 + [(None, "x y z", "b", lang) for lang in ("en", "de", None) for _ in range(7)] + [(3, "w", "c", "en"), (3, "w", "c", "en"), (3, "v", "c", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for keep in (("doc_id",), ("doc_id", "lang", "text")):
        out = mixing.mix(docs, keep=keep, weights={"a": 4.0, "b": 1.0, "c": 1.0}).collect()
        assert sorted(str(tuple(r[k] for k in keep)) for r in out) == sorted(str(tuple(dict(zip(docs.columns, row, strict=True))[k] for k in keep)) for row in rows)
        for s, longest in (("a", 2), ("b", 3), ("c", 1)):
            own = [r for r in out if r["sources"] == [s]]
            assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= longest
            assert max(r["copies"] for r in own) - min(r["copies"] for r in own) <= 1
        again = mixing.mix(docs.repartition(5).orderBy(F.desc("text")), keep=keep, weights={"a": 4.0, "b": 1.0, "c": 1.0}).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))
