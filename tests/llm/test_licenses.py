"""License scans against a word-by-word search."""

import re

from tessera.llm import licenses


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


MIT = licenses.PASSAGES[8][0]
TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "cc by cc by CC BY-NC 4.0 and Licensed under CC BY-NC 4.0.",
    "gnu general public license gnu general public " * 40,
    "İ gnu General é Public license; GNU GENERAL PUBLIC LICENSE 日本 apache\nlicense",
    "x " * 500 + MIT + " y" * 500,
    "intro " + MIT.replace("modify, merge, publish,", "modify, publish and really merge") + " mit",
    " ".join(reversed(MIT.split())),
    "apache",
]


def test_base_equals_brute_force(spark):
    rows = [*enumerate(TEXTS), (2, TEXTS[2]), (3, "other text of the same id, apache license"), (None, "mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as labels", "1 as tag", "2 as template").repartition(3)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_scan(docs).collect()), key=str)
    assert got == sorted(((d if d is not None else -1, *brute(t)) for d, t in rows), key=str)


def test_passages(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert got[2]["labels"] == "mit"
    assert got[3]["labels"] == "cc-by,cc-by-nc-4.0"
    assert got[6]["labels"] == "mit" and got[6]["score"] == 1.0 and got[6]["n_base"] == 0
    assert got[7]["labels"] == "mit" and 0.7 <= got[7]["score"] < 1
    assert got[8]["labels"] == "" and got[8]["score"] == 0
    assert licenses.license_scan(docs.limit(0)).count() == 0


def passages_by_brute_force(text):
    """label and share of every passage, by comparing all runs of words with all of every template's."""
    words, out, k = licenses.words_of(text), [], licenses.K_PASSAGE
    for source, label in licenses.PASSAGES:
        want = licenses.words_of(source)
        most = len(want) - k + 1
        on = {}
        for i in range(len(words) - k + 1):
            for j in range(most):
                if words[i : i + k] == want[j : j + k]:
                    on.setdefault(i - j, []).append(i)
        runs = []
        for d in sorted(on):
            if runs and d - runs[-1][-1] <= licenses.GAP and on[d][0] - on[runs[-1][-1]][-1] <= 4 * most:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            if sum(len(on[d]) for d in run) < licenses.VOTES * most:
                continue
            last, count = -1, 0
            for j, w in enumerate(want):
                places = [d + j for d in run if last < d + j < len(words) and words[d + j] == w]
                if places:
                    last, count = min(places), count + 1
            if count / len(want) >= licenses.COVER:
                out.append((label, count / len(want)))
    return out


def test_method_labels_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    texts = list(TEXTS)
    for _ in range(120):
        words = [rng.choice(["the", "of", "x", "license"]) for _ in range(rng.randrange(30))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            passage = rng.choice(licenses.PASSAGES)[0].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(passage) or 1)
                passage[at : at + rng.choice([0, 1, 2])] = [rng.choice(["the", "new"])] * rng.choice([0, 1])
            words[(at := rng.randint(0, len(words))) : at] = passage
        texts.append(" ".join(words))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    for i, text in enumerate(texts):
        found = passages_by_brute_force(text)
        base = brute(text)
        assert got[i]["labels"] == ",".join(sorted({x for x, _ in found} | set(filter(None, base[4].split(","))))), text
        assert abs(got[i]["score"] - (1.0 if base[1] else max((s for _, s in found), default=0.0))) < 1e-12
        assert sorted(s["label"] for s in got[i]["spans"] if not (s["share"] == 1.0 and s["end"] - s["start"] <= 4)) == sorted(x for x, _ in found)
        assert [s["start"] for s in got[i]["spans"]] == sorted(s["start"] for s in got[i]["spans"])


def test_many_equal_rows_a_long_text_and_many_without_id(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 7)
    long = "word " * 100_000 + "mit license " + "word " * 100_000
    rows = [(4, "apache license")] * 50 + [(None, f"mit license {i}") for i in range(700)] + [(None, "mit license 0")] * 3 + [(9, long)]
    for few in (licenses.FEW, 0):
        monkeypatch.setattr(licenses, "FEW", few)
        got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert len(got) == len(rows) and sum(r["doc_id"] == 4 and r["base_labels"] == "apache" for r in got) == 50
        assert sum(r["doc_id"] is None and r["n_words"] == 3 and r["n_base"] == 1 for r in got) == 703
        assert [r["first_word"] for r in got if r["doc_id"] == 9] == [100_000]
