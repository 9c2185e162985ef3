"""The pipeline's stages, each on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.llm.test_ngram_join import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from tessera.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = out[name] = stored(stage(spark, docs, SF), name)
    return {k: [r.asDict() for r in v.collect()] for k, v in out.items()}


def test_columns(spark, stages):
    names = set(stages["documents"][0])
    assert all(set(stages[n][0]) == names for n, _ in cp.STAGES[:-1])


def test_quality(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["quality_rules"]}
    for r in stages["documents"]:
        if labels.get(r["doc_id"]) is not None and len(r["text"].split()) >= 50:
            assert (r["doc_id"] in kept) == (labels[r["doc_id"]] == 1)


def test_near_duplicates(stages):
    before, after = stages["quality_rules"], stages["near_duplicates"]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    similar = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    kept = {r["doc_id"] for r in after}
    assert len(after) == len(kept)
    for i in kept:
        assert not any(similar(sets[i], sets[j]) for j in kept if j < i)
    for i in set(sets) - kept:
        assert any(similar(sets[i], sets[j]) for j in sets if j != i)


def test_personal_data(stages):
    assert len(stages["personal_data"]) == len(stages["near_duplicates"])
    text = " ".join(r["text"] for r in stages["personal_data"])
    assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    assert not re.search(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", text)


def test_mixing_and_tokens(stages):
    copies = Counter(r["doc_id"] for r in stages["mixing_to_weights"])
    assert max(copies.values()) <= 3 and set(copies) <= {r["doc_id"] for r in stages["personal_data"]}
    assert Counter(r["doc_id"] for r in stages["tokens"]) == copies
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in stages["tokens"])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None), sorted(r["text"] or "" for r in df.collect() if r["doc_id"] is None)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 9 else None, len(t or "")) for i, t in rows], SCHEMA)


A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


def test_near_duplicates_by_row(spark):
    judge = lambda *rows: rows_of(cp.near_duplicates(spark, table(spark, rows), SF))
    assert judge((3, A), (7, A), (7, B)) == ([(3, A), (7, B)], [])
    assert judge((7, A), (None, A), (None, B)) == ([(7, A)], [B])
    assert judge((None, A), (None, A), (None, B)) == ([], [A, B])
    got = judge((5, A), (5, A), (5, B), (5, B + " x"))
    assert got[0][0] == (5, A) and len(got[0]) == 2


def test_near_duplicates_keep_rows_without_words(spark):
    out = cp.near_duplicates(spark, table(spark, [(1, None), (2, ""), (2, ""), (None, " "), (4, C)]), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, " "), (1, ""), (2, ""), (2, ""), (4, C)]


def test_many_rows_without_id(spark):
    texts = [" ".join(f"{i}x{j}" for j in range(12)) for i in range(1500)]
    out = cp.near_duplicates(spark, table(spark, [(None, t) for t in texts] + [(None, texts[0])]), SF)
    assert sorted(r["text"] for r in out.collect()) == sorted(texts)


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_odd_rows_at_every_stage(spark, stage):
    """Nulls in any column, repeated rows, a very long text, and columns with names that stages use themselves."""
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    rows = [(1, A, "en", "s", 1), (1, A, "en", "s", 1), (2, B, None, None, None), (None, C, "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "t", 0), (5, long, "en", "t", 5)]
    extra = ("cls bigint", "tag string", "kept string", "copies int", "row string", "size string", "pattern string", "h int", "n int", "c0 int", "_m_email int")
    df = spark.createDataFrame([(*r, *(None if "int" in e else "z" for e in extra)) for r in rows], SCHEMA + ", " + ", ".join(e.replace("bigint", "long") for e in extra))
    out = stage(spark, df, SF)
    got = out.collect()
    if stage is not cp.tokens:
        assert out.columns == df.columns
        assert all(r["tag"] == "z" for r in got)
    ids = Counter(r["doc_id"] for r in got)
    if stage is cp.near_duplicates:
        assert ids == {1: 1, 2: 1, None: 1, 3: 1, 4: 1, 5: 1}
    elif stage in (cp.personal_data, cp.tokens):
        assert ids == {1: 2, 2: 1, None: 1, 3: 1, 4: 1, 5: 1}
    elif stage is cp.mixing_to_weights:
        assert 3 not in ids and 4 not in ids and ids[1] <= 6
