"""Text search by positions against the scan, and its tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import positions, search
from tests.repos import queries

LINES = "repo string, path string, line long, content string"
WORDS = ["the", "The", "a", "b", "ab", "aaa", "é", "ÉÉ", "Σς", "x_y", "50%", "back\\slash", "İi", "aaaa", "new york"]


def index_of(spark, lines, tmp_path_factory, name="i"):
    folder = str(tmp_path_factory.mktemp(name))
    positions.write(lines, f"{folder}/x")
    return positions.read(spark, f"{folder}/x")


def made(seed, n=300):
    rng = random.Random(seed)
    at = {(f"r{rng.randrange(3)}", f"p{rng.randrange(9)}.py", i) for i in range(n)}
    return [(*k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for k in at] + [("r0", "s", 1, "a"), ("r0", "s", 2, "ab"), ("r1", "s", 3, "%"), ("r1", "s", 4, "the " * 30_000)]


def found(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_equals_scan(spark, tmp_path_factory):
    lines = spark.createDataFrame(made(1), LINES).repartition(3)
    index = index_of(spark, lines, tmp_path_factory)
    asked = queries(spark, "the", "the ", "THE A", "aa", "aaa", "aaaa", "a", "%", "_a", "é", "éé", "Σς", "σς", "x_y", "k\\s", "i̇", "new york", "nothing here", "b a", "\\", "50%")
    for limit in (1, 4, 200):
        assert found(search.text_search(lines, asked, limit)) == found(search.text_search(lines, asked, limit, index=index))
    budgets = asked.select("query_id", F.explode(F.array(F.lit("r0"), F.lit("r2"))).alias("repo"), (F.col("query_id") % 4).cast("int").alias("budget"))
    assert found(search.text_search(lines, asked, 5, budgets)) == found(search.text_search(lines, asked, 5, budgets, index=index))


def test_more_trigrams_or_queries_than_are_told(spark, tmp_path_factory, monkeypatch):
    lines = spark.createDataFrame(made(2), LINES)
    index = index_of(spark, lines, tmp_path_factory)
    asked = queries(spark, "the a", "aaa", "ab", "new york", "x_y", "_b")
    want = found(search.text_search(lines, asked, 7))
    few = positions.places_of(index, asked.where(positions.served(F.col("query"))), most_grams=3)
    assert found(few) == found(positions.places_of(index, asked.where(positions.served(F.col("query")))))
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert found(search.text_search(lines, asked, 7, index=index)) == want
    monkeypatch.setattr(search, "MOST_TOP", 1)
    assert found(search.text_search(lines, asked, 7, index=index)) == want


def test_empty(spark, tmp_path_factory):
    lines = spark.createDataFrame([], LINES)
    index = index_of(spark, lines, tmp_path_factory)
    assert search.text_search(lines, queries(spark, "abc"), 5, index=index).count() == 0
    with pytest.raises(ValueError, match="empty"):
        search.text_search(lines, queries(spark, " "), 5, index=index)


def test_segments_follow_the_order_of_lines(spark):
    rows = positions.numbered(spark.createDataFrame(made(3), LINES).repartition(4), chars=400, most=9).collect()
    assert max(r["at"] for r in rows) <= 8 and len({r["segment"] for r in rows}) > 30
    for repo in ("r0", "r1", "r2"):
        own = sorted((r["segment"], r["at"], r["path"], r["line"]) for r in rows if r["repo"] == repo)
        assert [x[2:] for x in own] == sorted(x[2:] for x in own)
    assert len({(r["segment"], r["at"]) for r in rows}) == len(rows)


def test_places_in_small_segments(spark):
    """Places, counts and lengths of every line, whatever the segments."""
    rows = [("r", "p", i, c) for i, c in enumerate(["abcabc", "xabc", "ab", "cab", "b", "bcabca"])]
    own = positions.numbered(spark.createDataFrame(rows, LINES), chars=12, most=3)
    index = positions.Index(own, positions.postings(own), positions.mean_lengths(own), positions.postings(own).where("gram <> ''").select("gram").distinct())
    at = {(r["segment"], r["at"]): r["content"] for r in own.collect()}
    got = {(r["query_id"], at[r["segment"], r["at"]], r["tf"], r["length"]) for r in positions.places_of(index, queries(spark, "abc", "bca", "cabc", "b")).collect()}
    assert {g for g in got if g[0] < 4} == {(1, "abcabc", 2, 6), (1, "xabc", 1, 4), (1, "bcabca", 1, 6), (2, "abcabc", 1, 6), (2, "bcabca", 2, 6), (3, "abcabc", 1, 6), (3, "bcabca", 1, 6)} - {(3, "bcabca", 1, 6)} | {(3, "bcabca", 1, 6)}
    assert {g[1] for g in got if g[0] == 4} == {"abcabc", "xabc", "ab", "cab", "b", "bcabca"}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abAé %_\\", min_size=1, max_size=9).filter(lambda t: t.strip()), min_size=1, max_size=30), st.lists(st.text("abAé %_\\", min_size=1, max_size=5).filter(lambda t: t.strip()), min_size=1, max_size=6))
def test_any_text(spark, tmp_path_factory, contents, asked):
    lines = spark.createDataFrame([("r", f"p{i % 3}", i, c) for i, c in enumerate(contents)], LINES)
    index = index_of(spark, lines, tmp_path_factory)
    q = queries(spark, *asked)
    assert found(search.text_search(lines, q, 3)) == found(search.text_search(lines, q, 3, index=index))


def test_published_tables_are_made_anew_once_removed(spark):
    from tessera.plans import catalogue
    from tessera.sources import shared

    sf = "/root/testdata/sf0.001"
    names = ("catalog_counts", "text_search_indexed", "file_search")
    before = {n: found(catalogue.QUERIES[n](spark, sf)) for n in names}
    assert shared.clear(spark) > 0
    assert {n: found(catalogue.QUERIES[n](spark, sf)) for n in names} == before
