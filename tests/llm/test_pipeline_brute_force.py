"""The whole pipeline against a plain reading of each stage: loops, regular expressions, sorting and the tokenizers library."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import mixing, pii, quality
from tessera.llm.grams import WordTable
from tests.llm import test_quality as q
from tests.llm.test_ngram_join import shingle_set
from tests.llm.test_pii import PATTERNS, holds, put_out

SF = "/root/testdata/sf0.001"


def kept_by_quality(docs, labels):
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1}
    grams = {}
    raw, target = Counter(), Counter()
    for d in docs:
        table = WordTable()
        grams[d["doc_id"]] = [int(g) % quality.BUCKETS for g in table.features(table.rows((d["text"] or "").encode().split()))]
        raw.update(grams[d["doc_id"]])
        if d["doc_id"] in trusted:
            target.update(grams[d["doc_id"]])
    import math

    total = [sum(c.values()) + quality.BUCKETS for c in (target, raw)]
    ratio = {b: math.log((target[b] + 1) / total[0]) - math.log((raw[b] + 1) / total[1]) for b in raw}
    return [d for d in docs if not q.brute(d["text"])[-1] and sum(ratio[b] for b in grams[d["doc_id"]]) / len(grams[d["doc_id"]]) >= quality.THRESHOLD]


def one_of_each(docs):
    sets = [shingle_set(d["text"]) for d in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if find(i) not in least or d["doc_id"] < docs[least[find(i)]]["doc_id"]:
            least[find(i)] = i
    return [docs[i] for i in sorted(least.values())]


RUN = r"[A-Za-z0-9_-]{15,}"
ADDED = {
    "key": (RUN, lambda m: re.fullmatch(pii.KEY_FORMS, m)),
    "secret": (RUN, lambda m: re.search("[0-9]", m) and re.search("[A-Za-z]", m)),
    "ssn": (r"[0-9-]{11,}", lambda m: re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m)),
}


def without_personal_data(text):
    kinds = {k.name: k for k in pii.KINDS}
    assert not re.search(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", text)  # account numbers have a test of their own
    spans = []
    for name in ("email", "key", "secret", "card", "phone", "ip", "ssn"):
        kind = kinds[name]
        pattern, good = (PATTERNS[name], lambda m: holds(name, m)) if name in PATTERNS else ADDED[name]  # noqa: B023
        matches = list(re.finditer(pattern, text))
        at = 0
        for i, m in enumerate(matches):
            before, after = text[at : m.start()], text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
            near = (before[-pii.NEAR :] + "\n" + after[: pii.NEAR]).lower()
            says = lambda words: re.search(rf"(^|[^a-z0-9])({words})([^a-z0-9]|$)", near)  # noqa: B023, E731
            score = min(100, kind.score + (pii.RAISED if says(kind.words) else 0)) - (pii.LOWERED if says(pii.AGAINST) else 0)
            if good(m.group()) and (kind.base or score >= pii.LEAST):
                spans.append((m.start(), m.end(), name))
            at = m.end()
    return put_out(text, spans)


def mixed(spark, docs):
    size = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}
    rows = spark.createDataFrame([(d["doc_id"], size[d["doc_id"]], d["text"]) for d in docs], "doc_id long, size long, text string").select("doc_id", mixing.seeded(7, F.col("text")).alias("h")).collect()
    place = {r["doc_id"]: r["h"] for r in rows}
    of = defaultdict(list)
    for d in docs:
        of[d["source"]].append(d["doc_id"])
    sizes = {s: sum(size[i] for i in ids) for s, ids in of.items()}
    target = mixing.quotas(sizes, mixing.default_weights(list(sizes)), sum(sizes.values()))
    copies = Counter()
    for s, ids in of.items():
        whole, rest = divmod(min(round(target[s]), 3 * sizes[s]), sizes[s])
        used = 0
        for i in sorted(ids, key=place.get):
            more = used + size[i] / 2 <= rest
            if rest and more and used <= rest:
                copies[i] += whole + 1
            else:
                copies[i] += whole
            used += size[i]
    return copies


def test_pipeline_equals_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs = one_of_each(kept_by_quality(docs, labels))
    for d in docs:
        d["text"] = without_personal_data(d["text"])
    copies = mixed(spark, docs)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path(cp.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = Counter()
    for d in docs:
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        digest = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        decoded = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want[d["doc_id"], len(ids), digest, decoded] += copies[d["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, SF).collect())
    assert len(got) > 30 and got == +want
