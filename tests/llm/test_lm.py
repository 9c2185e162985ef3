"""Stupid backoff against dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PythonException

from tessera.llm import lm
from tessera.llm.common import WordHash


def expected(texts):
    """(n_words, score) of each text."""
    words = [(t or "").split() for t in texts]
    c = Counter(tuple(w[i : i + n]) for w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def score(w, i):
        if i > 1 and c[tuple(w[i - 2 : i + 1])] >= 2:
            return math.log(c[tuple(w[i - 2 : i + 1])] / c[tuple(w[i - 2 : i])])
        if i > 0 and c[tuple(w[i - 1 : i + 1])] >= 2:
            return math.log(0.4 * c[tuple(w[i - 1 : i + 1])] / c[(w[i - 1],)])
        return math.log(0.16 * c[(w[i],)] / total)

    return [(len(w), sum(score(w, i) for i in range(len(w))) / len(w) if w else None) for w in words]


def same(got, ids, texts):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    got = sorted(((r["doc_id"], r["n_words"], r["score"]) for r in got), key=key)
    want = sorted(((i, *e) for i, e in zip(ids, expected(texts), strict=True)), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] is None if w[2] is None else abs(g[2] - w[2]) < 1e-6


TEXTS = ["a b c a b c a", "a b d", "x", "", None, " \n", "b c a b", "é ü é ü"]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    same(lm.lm_scores(docs).collect(), range(len(TEXTS)), TEXTS)
    assert lm.lm_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block_chars, part_grams", [(200, 200), (2_000, 100_000)])
def test_several_blocks_and_parts(spark, block_chars, part_grams):
    rng = random.Random(block_chars)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 3, 20, 60]))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    same(lm.lm_scores(docs, block_chars, part_grams).collect(), range(len(texts)), texts)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b a b")] * 3 + [(1, "a c"), (1, ""), (1, ""), (None, "a b"), (None, "a b"), (None, None), (None, " ")]
    same(lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), [i for i, _ in rows], [t for _, t in rows])


def test_clashing_columns_and_a_very_long_text(spark):
    texts = ["w" + " x y" * 200_000, "x y x", "z"]
    docs = spark.createDataFrame([(i, t, 5, 6, "b") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, score int, block string")
    same(lm.lm_scores(docs, 200_000).collect(), range(3), texts)


def test_one_word_everywhere_and_copies(spark):
    texts = ["the the the the"] * 300 + ["the end"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    same(lm.lm_scores(docs, 2_000, 500).collect(), range(len(texts)), texts)


@pytest.mark.parametrize("n", [0, 1, 5, 3_000, 300_000])
def test_parts_are_sized_by_what_blocks_send(n):
    """Words of one or two letters give more than an n-gram a character; what a block sends is counted, not taken from its length."""
    rng = random.Random(n)
    texts = [" ".join(str(rng.randrange(100)) for _ in range(n)).encode()]
    words = lm.Words(WordHash(), np.array([len(t) for t in texts], np.int32), b"".join(texts))
    sent = sum(len(np.unique(words.grams(k))) for k in lm.ORDERS)
    assert abs(lm.sent_by(words) - sent) <= 0.02 * sent
    if n == 300_000:
        edges = lm.part_bounds(np.unique(words.grams(3)), 20)
        assert max(np.diff(edges)) < 1.05 * edges[-1] / 20


def test_a_block_that_changes_is_an_error(spark):
    """Blocks of the same number and size, but of other rows than those counted, give no scores."""
    one, two = (lm.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1_000) for rows in ([(1, "a b c"), (2, "c b a")], [(2, "c b a"), (1, "a b c")]))
    assert lm.summed(one, lm.counted(lm.asked(one, 2), 2)).count() == 2
    with pytest.raises(PythonException, match="changed while it was counted"):
        lm.summed(one, lm.counted(lm.asked(two, 2), 2)).collect()
