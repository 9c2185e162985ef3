"""Quality rules against plain loops over the same definitions."""

import math
import re
from collections import Counter

import pytest

from tessera.llm import quality
from tessera.llm.grams import WordTable

GOOD = "The quick brown fox jumps over the lazy dog and then it runs away from all of them. "
JUNK = "Buy*** now$$$ cheap### pills&&& best*** price%%% "
TEXTS = [None, "", " \n\t ", "one two three", "a b c " * 30, GOOD * 8, JUNK * 12, GOOD * 5 + "\n\nsame line here\nsame line here\n \nsame line here", "é ü 日本\x0bx\x1fy\x85z \xa0 #|<>" * 20, "w " * 5000]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def ratios(texts, trusted, buckets):
    raw, target = Counter(), Counter()
    for i, t in texts:
        table = WordTable()
        grams = Counter(int(g) % buckets for g in table.features(table.rows((t or "").encode().split())))
        raw += grams
        if i in trusted:
            target += grams
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + buckets)
    return [math.log(p(target, b)) - math.log(p(raw, b)) if target else 0.0 for b in range(buckets)]


@pytest.mark.parametrize("trusted", [{5, 7}, set()])
def test_equals_brute_force(spark, trusted):
    rows = [*enumerate(TEXTS), (5, TEXTS[5]), (None, GOOD * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as llr").repartition(3)
    got = sorted((tuple(r) for r in quality.quality_rules(docs, trusted, buckets=512).collect()), key=str)
    table = ratios(rows, trusted, 512)
    want = []
    for i, t in rows:
        words = WordTable()
        grams = words.features(words.rows((t or "").encode().split()))
        llr = sum(table[int(g) % 512] for g in grams) / len(grams) if len(grams) else 0.0
        base = brute(t)
        want.append((i, *base, not base[-1] and llr >= quality.THRESHOLD, llr))
    want.sort(key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:-1] == w[:-1] and abs(g[-1] - w[-1]) < 1e-9


def test_a_very_long_text_and_ties_at_the_threshold(spark):
    long = " ".join(f"w{i % 30_000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, GOOD * 8), (2, GOOD * 8)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, {2}).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["base_failed"]) == (200_000, 200_000, True)
    even = quality.quality_rules(docs.where("doc_id = 1").selectExpr("doc_id", "substr(text, 1, 3000) AS text"), [], threshold=0.0).first()
    assert even["llr"] == 0.0 and even["kept"]


def test_empty(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string"), []).count() == 0


def test_every_trusted_document_counts(spark):
    n = 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('w', id, ' of it') AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'a b c'"))
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality").union(spark.sql("SELECT 7, 1")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    raw, target = quality.gram_counts(docs, quality.all_trusted(labels), 512).selectExpr("sum(raw)", "sum(target)").first()
    assert (raw, target) == (10 * (n + 1), 10 * n)  # 4 n-grams a word but 2, of three words


def test_query_and_pipeline_take_all_labels(spark, monkeypatch):
    import corpus_pipeline
    from tessera.llm import queries

    seen = []
    monkeypatch.setattr(quality, "gram_counts", lambda docs, trusted, *a: seen.append(trusted) or spark.createDataFrame([], "bucket long, raw long, target long"))
    sf = "/root/testdata/sf0.001"
    queries.op1_quality_rules(spark, sf)
    corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    want = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id").distinct().count()
    assert [t.count() for t in seen] == [want, want]


@pytest.mark.parametrize("bit_words", [1, 4, quality.BIT_WORDS])
def test_only_texts_that_may_be_trusted_are_moved_at_any_size(spark, bit_words):
    docs = spark.range(400).selectExpr("id % 300 AS doc_id", "concat('text ', id) AS text").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'none'"))
    trusted = spark.range(0, 300, 3).selectExpr("id AS doc_id")
    rows = quality.marked(docs, trusted, bit_words)
    got = sorted((r["text"], r["trusted"]) for r in rows.collect())
    assert got == sorted([(f"text {i}", True if i % 300 % 3 == 0 else None) for i in range(400)] + [("none", None)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Union" in plan  # the same join for few ids as for many


def test_edges_of_words():
    from tessera.llm.grams import EDGES, edges

    for word in (b"", b"a", b"--", b"*a.b*", b"9%", b"\x1fx\x00", b"_a_", "é,".encode(), "«日本»".encode(), b"\xff"):
        assert edges(word) == EDGES.match(word.decode("utf-8", "replace")).groups()


def test_tasks_send_blocks_of_counts(spark):
    docs = spark.range(130).selectExpr("id AS doc_id", f"concat('{GOOD}', id) AS text").repartition(130)
    counts = quality.gram_counts(docs, range(10))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "[start#" in plan and "FlatMapGroupsInArrow" in plan
    raw, target, n, distinct = counts.selectExpr("sum(raw)", "sum(target)", "count(*)", "count(DISTINCT bucket)").first()
    words = 19
    assert (raw, target) == (130 * (4 * words - 2), 10 * (4 * words - 2)) and n == distinct
