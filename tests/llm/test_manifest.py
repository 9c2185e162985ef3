"""Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(value, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and each node's siblings level by level as (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            steps[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            at[i] = p // 3
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], steps


def expected(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: climb([leaf(*r) for r in g]) for s, g in groups.items()}
    if not rows:
        return []
    root, tops = climb([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, own in zip(groups[s], trees[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf(r[0], r[1].replace("\n", "") if tampered and r[1] is not None else r[1], *r[2:])
            for a, b in own + top:
                at = sha(a, at, b)
            out.append((r[0], leaf(*r), trees[s][0], root, sha(*(x for step in own + top for x in step)), at, at == root))
    return out


def same(spark, rows):
    got = manifest.manifest_digests(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(rows)))


def test_equals_plain_tree(spark):
    rows = [(i, f"line {i}\nnext\n" if i % 3 else f"plain {i}", "en", f"s{i % 5}" if i % 7 else "big", 9) for i in range(90)]
    same(spark, rows)
    assert {r["verified"] for r in manifest.manifest_digests(spark.createDataFrame(rows, SCHEMA)).collect()} == {True, False}


def test_odd_rows(spark):
    rows = [(None, "a\nb", None, None, None), (None, None, "en", None, 3), (7, "", "", "", 0), (7, "x\n" * 40_000, "é", "ü", -1), (2, "\n", "en", "Z", 1), (2, "\n", "en", "Z", 1), (2, "other", "en", "Z", 5)]
    same(spark, rows + [(5, "same\n", "en", "copies", 5)] * 20)
    same(spark, rows[:1])


def test_empty(spark):
    same(spark, [])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(-3, 30), st.none() | st.text("ab\né", max_size=4), st.none() | st.just("en"), st.none() | st.sampled_from(["a", "B", "é", ""]), st.none() | st.integers(0, 3)), max_size=30))
def test_any_rows(spark, rows):
    same(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_a_group(spark, n):
    same(spark, [(i, "t\n", "en", "one", 2) for i in range(n)])


def test_proofs_are_steps(spark):
    """The operator's own output: any subset of rows can be checked against the root with nothing else."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 2}", 2) for i in range(20)], SCHEMA).withColumn("digest", F.lit("clash")).withColumn("place", F.lit(1))
    rows = manifest.merkle_manifest(docs, keep={"id": F.col("doc_id"), "clash": F.col("digest")}).collect()
    for r in rows:
        at = r["leaf"]
        for left, right in r["steps"]:
            at = sha(left, at, right)
        assert at == r["root"] and r["clash"] == "clash"
    assert sorted(r["id"] for r in rows) == list(range(20))


def test_places_without_a_task_for_a_group(spark):
    """Numbers follow the order over all ranges of one large group."""
    rows = spark.range(1000).select(F.lit("g").alias("grp"), (999 - F.col("id")).alias("o"), F.lit("d").alias("digest"))
    got = manifest.ranked(rows, ["o", "digest"]).collect()
    assert all(r["place"] == r["o"] and r["n"] == 1000 for r in got)
