"""Benchmark decontamination against plain windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import decontamination
from tessera.llm.common import WordHash

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, window):
    runs = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            runs.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(r) for r in runs}:
            for i in range(len(w) - k + 1):
                if (run := tuple(w[i : i + k])) in runs:
                    hit |= set(range(i, i + k))
                    found |= runs[run]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def same(spark, docs, items, window=10):
    got = decontamination.hit_digests(*tables(spark, docs, items), window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(docs, items, window)))


def made(seed, window):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["a", "b", "C", "d.", "é", "9-x"]) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, window - 1, window, window + 5]))) for i in range(12)] + [(3, line(window)), (None, line(window)), (None, "zz yy"), (20, None)]
    docs = [(i, line(rng.randrange(60))) for i in range(40)] + [(i, f"{line(4)} {items[i % 12][1].upper()}; {line(3)}") for i in range(30)]
    return docs, items


def test_equals_brute_force(spark):
    for window in (3, 10):
        same(spark, *made(window, window), window)


def test_odd_rows(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item"), (3, ""), (4, None), (5, "ten nine")]
    docs = [(None, None), (None, "short ITEM"), (1, ""), (1, "short item short-item"), (1, "short item short-item"), (2, "x " * 50_000 + "one two three four five six seven eight nine ten eleven " + "y " * 50_000), (3, "ten, nine? eight"), (4, "two three four five six seven eight nine ten")]
    same(spark, docs, items)
    same(spark, docs, [])
    same(spark, [], items)


def test_items_with_windows_in_common(spark):
    shared = " ".join(f"w{i}" for i in range(10))
    same(spark, [(1, shared), (2, f"{shared} {shared}")], [(i, f"{shared} tail{i}") for i in range(30)])


def test_blocks_give_the_same(spark):
    docs, items = made(5, 4)
    docs, items = tables(spark, docs + docs[:5] + [(None, None)], items)
    rows = lambda **kw: sorted(map(repr, decontamination.benchmark_hits(docs, items, 4, **kw).collect()))
    assert rows(block_bytes=200) == rows()


def test_equal_hashes_are_told_apart():
    """Windows are verified by their words: a table whose hashes are all those of another window gives no hit."""
    w = [b"a", b"b", b"c"]
    hashes = WordHash().of(w)
    forged = decontamination.signed(decontamination.rolling(hashes, 3))
    table = lambda run: decontamination.Windows(pa.table({"hash": pa.array(forged, pa.int64()), "size": pa.array([3], pa.int32()), "words": pa.array([run], pa.binary()), "item": ["1"]}))
    assert table(b"a b x").find(w, hashes) == ([], [], [])
    assert table(b"a b c").find(w, hashes) == ([0], [3], ["1"])
    assert table(b"a b c").find([], np.empty(0, np.uint64)) == ([], [], [])


def test_spans_and_documents_go(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep: ALPHA, beta gamma! and alpha beta", 5, "x"), (2, "clean", 6, "y"), (3, None, 7, None), (2, "clean", 6, "y")], "doc_id long, text string, n_words long, row string").withColumn("row", F.col("row"))
    got = decontamination.decontaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "Keep: ! and alpha beta", 5, "x"), (2, "clean", 6, "y"), (2, "clean", 6, "y"), (3, None, 7, None)]))
    assert sorted(r["doc_id"] for r in decontamination.decontaminated(docs, items, whole=True).collect()) == [2, 2, 3]
    left = decontamination.benchmark_hits(got, items)
    assert left.where(F.size("starts") > 0).count() == 0
