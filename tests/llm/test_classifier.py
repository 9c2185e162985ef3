"""The classifier by held-out accuracy, and its updates by a plain reading."""

import math
import random
import zlib

import numpy as np

from tessera.llm import classifier


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta omega sigma theta kappa".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(1, 80))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words if good else [w + rng.choice(["***", "$$$"]) for w in words]), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "0 as quality", "1.0D as score").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(7, None)], "doc_id long, quality int")
    got = classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] not in (3, 4)]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    again = {(r["doc_id"], r["score"]) for r in classifier.quality_classifier(docs.repartition(7), labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    ids = [i for i, _ in classifier.labelled(labels)]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert len(classifier.labelled(labels, sample=10)) == 20


def test_update_is_that_of_the_paper():
    model, z, n, rng = classifier.FTRL(8), [0.0] * 9, [0.0] * 9, np.random.default_rng(0)
    for _ in range(50):
        at = rng.choice(8, 3, replace=False)
        value, label = rng.random(3), int(rng.integers(2))
        model.learn(at, value, label, 1.0)
        x = {**{int(i): float(v) for i, v in zip(at, value, strict=True)}, 8: 1.0}
        w = {i: 0.0 if abs(z[i]) <= classifier.L1 else -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / classifier.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in classifier.quality_classifier(docs, labels).collect()] == [0.5]
    assert classifier.quality_classifier(docs.limit(0), labels).count() == 0


MASK = (1 << 64) - 1


def scrambled(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def plain_vector(text, dimensions):
    """Word by word: hashed cores, shapes and their pairs, square roots of counts at a fixed length."""
    import regex
    import xxhash

    salts = [0x100000001B3 * (2 * i + 1) for i in range(5)]
    cores, shapes = [], []
    for word in (text or "").encode().split():
        word = word.decode()
        before = regex.match(r"[^\p{L}\p{N}]*", word)[0]
        core = word[len(before) :].rstrip() if regex.search(r"[\p{L}\p{N}]", word) else ""
        after = regex.search(r"[^\p{L}\p{N}]*$", core)[0] if core else ""
        core = core[: len(core) - len(after)]
        case = "-" if not core else "9" if core.isdigit() else "AA" if len(core) > 1 and core.isupper() else "Aa" if core[0].isupper() else "a" if core.islower() else "mixed"
        cores.append(xxhash.xxh3_64_intdigest(core.lower()))
        shapes.append(xxhash.xxh3_64_intdigest(f"{before[:8]} {case} {after[:8]}"))
    mix = 0x9E3779B97F4A7C15
    grams = [c ^ salts[0] for c in cores] + [s ^ salts[1] for s in shapes]
    grams += [salts[4] if a == b else (a * mix + b + salts[2]) & MASK for a, b in zip(cores, cores[1:])]
    grams += [(a * mix + b + salts[3]) & MASK for a, b in zip(shapes, shapes[1:])]
    counts = {}
    for g in grams:
        counts[scrambled(g) % dimensions] = counts.get(scrambled(g) % dimensions, 0) + 1
    length = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(c) * classifier.SCALE / max(1e-9, length) for k, c in counts.items()}


def test_scores_equal_a_plain_reading(spark):
    """Every row's score against the same model learned and applied in dictionaries."""
    rows = corpus(120, 4) + [(500, "", 1), (501, "word " * 3000 + "w***", 0), (502, "Ab cD 12 -- x2!", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "alpha***")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 or i > 400], "doc_id long, quality int")
    dimensions = classifier.DIMENSIONS
    texts = {i: t for i, t, _ in rows}
    truth = {i: y for i, _, y in rows if i % 4 or i > 400}
    learn = sorted((i for i in truth if zlib.crc32(str(i).encode()) % 5), key=lambda i: (i * 2654435761 % (1 << 32), i))
    share = [max(1, sum(truth[i] == k for i in learn)) for k in (0, 1)]
    z, n = {}, {}
    of = lambda k: 0.0 if abs(z.get(k, 0.0)) <= classifier.L1 else -(z[k] - math.copysign(classifier.L1, z[k])) / ((classifier.BETA + math.sqrt(n[k])) / classifier.ALPHA + classifier.L2)
    for _ in range(classifier.EPOCHS):
        for i in learn:
            x = {k: float(np.float32(v)) for k, v in plain_vector(texts[i], dimensions).items()} | {dimensions: 1.0}
            w = {k: of(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - truth[i]) * v * len(learn) / 2 / share[truth[i]]
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / classifier.ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    weights = {k: of(k) for k in z}
    got = classifier.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        x = plain_vector("alpha***" if r["doc_id"] is None else texts[r["doc_id"]], dimensions)
        p = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) * v for k, v in x.items()) - weights[dimensions]))
        assert abs(p - r["score"]) < 1e-6 and r["predicted"] == (r["score"] >= 0.3)
