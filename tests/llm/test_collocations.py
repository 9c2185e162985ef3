"""Collocations against plain counts."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split("[.,;:!?\n\v\f\r]", folded) if (w := re.findall("[^ \t]+", p))]


def expected(rows, least, top, longest=5, share=100):
    f, n = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if (q := p[i : i + m]) in found and 100 * a >= share * found[q]}
        scored = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def same(spark, rows, least, top=2000, **options):
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=least, top=top, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == expected(rows, least, top)


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "new", "york", "city", "of", "Été", "a", "b", "*", "of the"]
    line = lambda: " ".join(rng.choices(words, [9, 3, 3, 2, 6, 1, 4, 4, 1, 3], k=rng.randrange(1, 30)))
    end = lambda: rng.choice([". ", ",", "\n", " \t ", "; New York City ! "])
    return [(i, "".join(line() + end() for _ in range(rng.randrange(4))), rng.choice(["en", "de", None, "und", ""])) for i in range(n)]


def test_equals_brute_force(spark):
    for seed, least in ((1, 5), (2, 2), (3, 20)):
        same(spark, made(seed), least)


def test_top_and_ties(spark):
    rows = made(4)
    same(spark, rows, 3, top=4)
    same(spark, [(i, f"{a} {b}.{c} {d}", "en") for i, (a, b, c, d) in enumerate([("x", "y", "v", "w")] * 6)], 3, top=1)


def test_repeats_overlap(spark):
    same(spark, [(1, "a a a a a a, a a a", "en"), (2, "b b b.b b b", "en"), (2, "b b b.b b b", "en")], 2)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "", "en"), (1, " \t\n.,;", "en"), (2, "lone", "fr"), (3, "wide word " * 60_000, "en"), (4, "wide word\x0b wide\x1cword wide\xa0word", "en"), (4, "A" * 300_000, "en")]
    same(spark, rows, 2)
    same(spark, [], 2)
    same(spark, rows[:3], 1)


@pytest.mark.parametrize("options", [{"bits": 18, "scan_bytes": 40}, {"scan_bytes": 100}, {"bits": 20}])
def test_widths_and_scans_give_the_same(spark, options):
    same(spark, made(6, 30), 4, **options)


def test_saturated_sketch_gives_the_same(spark, monkeypatch):
    """If every counter reaches the threshold all phrases are candidates, and the result is what it was."""
    ones = lambda *a, **k: collocations.Bits(18, collocations.np.full(1 << 15, 255, collocations.np.uint8))
    monkeypatch.setattr(collocations, "sketch", ones)
    same(spark, made(7, 20), 4)


def test_bounds_are_never_too_low(spark):
    """Whatever is held back when tasks count: every pair with the threshold's places has its bit."""
    rows = made(8, 80)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "text").repartition(5)
    bits = collocations.sketch(docs, 18, 6, 5)
    counts = Counter((("und" if lang is None else lang), *p) for _, text, lang in rows for w in pieces(text) for p in zip(w, w[1:], strict=False))
    hashes = collocations.WordHash()
    for (lang, *pair), n in counts.items():
        h, _ = collocations.Grams(hashes, lang, [[w.encode() for w in pair]]).of(2)
        assert n < 6 or bits.has(h)[0]


def test_products_beyond_64_bits(spark):
    f = spark.createDataFrame([("en", "a b", 4 * 10**12), ("en", "a", 5 * 10**12), ("en", "b", 6 * 10**12)], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 9 * 10**12)], "lang string, n long")
    (row,) = collocations.scored(f, sizes, 100, 10, 100).collect()
    assert row["score"] == 1000 * 4 * 10**12 * 9 * 10**12 // (5 * 10**12 * 6 * 10**12)


def test_share_of_longer_phrases(spark):
    rows = [(i, "red big house" if i % 5 else "red big", "en") for i in range(50)]
    got = {r["phrase"] for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=5, share=70).collect()}
    assert got == {"red big house"}


def test_automata_of_words_count_what_stands(monkeypatch):
    """Patterns that are parts of others, that overlap, and pieces longer than what is put through at a time."""
    rng = random.Random(9)
    for run in (1, 4, 64):
        monkeypatch.setattr(collocations, "RUN", run)
        for _ in range(20):
            pieces_ = [rng.choices(["a", "b", "é", "other"], k=rng.choice([1, 2, 5, 64, 65, 200])) for _ in range(rng.randrange(1, 5))]
            patterns = sorted({" ".join(rng.choices(["a", "b", "é"], k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))})
            made = collocations.Automaton(collocations.pa.array(patterns))
            places = collocations.Places(zip(made.words.to_pylist(), range(9), strict=False))
            met = made.states(collocations.np.array([places[w] for p in pieces_ for w in p]), collocations.np.array([len(p) for p in pieces_]))
            got = made.counts(collocations.np.bincount(met[met >= 0], minlength=len(made.fail)))
            f = Counter(" ".join(p[i : i + k]) for p in pieces_ for k in range(1, 6) for i in range(len(p) - k + 1))
            assert got.tolist() == [f[p] for p in patterns]


def test_hashes_met_before_are_not_merged_with_each_chunk():
    met, all_of, moved = collocations.Met(), set(), 0
    for i in range(300):
        h = collocations.np.arange(i * 10, i * 10 + 10, dtype=collocations.np.uint64)
        assert met.has(h).sum() == 0
        longest = met.runs[0] if met.runs else None
        met.add(h[::-1])
        moved += longest is not None and met.runs[0] is not longest
        all_of.update(h.tolist())
    assert moved < 20 and len(met) == len(all_of) and met.has(collocations.np.array(sorted(all_of), collocations.np.uint64)).all()
    assert len(met.runs) < 12 and not met.has(collocations.np.array([3000, 2**63], collocations.np.uint64)).any()


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """What all passes read are numbers of words, of which the texts' pieces can be made again."""
    rows = made(11, 40)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, 'und') AS lang", "text")
    got, want = Counter(), Counter()
    for lang, w in collocations.words_of(iter(collocations.worded(docs.repartition(3)).toArrow().to_batches())):
        at = iter(w.at.tolist())
        got.update((lang, *(w.words[next(at)] for _ in range(n))) for n in w.sizes.tolist())
    for _, text, lang in rows:
        want.update(("und" if lang is None else lang, *(x.encode() for x in p)) for p in pieces(text))
    assert got == want
    read = []
    monkeypatch.setattr(collocations, "sketch", lambda docs, *a, f=collocations.sketch: read.append(docs.columns) or f(docs, *a))
    same(spark, rows, 3)
    assert read == [["lang", "words", "at", "sizes"]] * 2
