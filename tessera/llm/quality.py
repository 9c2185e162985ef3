"""Quality rules: text statistics, and a log-likelihood ratio between two multinomials of hashed n-grams.

Every document adds its n-gram counts to the raw corpus' multinomial, and every trusted one adds its to the target's.
Which documents may be trusted is told by a table of bits of fixed size, set by hashes of trusted ids and sent to the tasks;
only those are shuffled, sorted and joined to the ids, at any size alike, so that what is moved grows in proportion. Tasks
sum the counts in one array each; the arrays are added in blocks of buckets, of neighbouring tasks first, so the driver gets
one row for each of a fixed number of buckets, however large the corpus. In a second pass, without a shuffle, each document's score is the mean, over its n-grams,
of log p_target - log p_raw, and a fixed threshold decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACE, id_and_text, per_row, texts_of
from tessera.llm.grams import WordTable

BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Rows of one id are dealt over so many keys.
SALTS = 8
#: Buckets of a row of counts, and tasks whose rows are added first, so that no group grows with the input alone.
BLOCK, NEIGHBOURS = 1 << 10, 64
#: Words of 64 bits that tell which ids may be trusted.
BIT_WORDS = 1 << 18
#: Mean log-likelihood ratio below which a document goes.
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


def all_trusted(labels: DataFrame) -> DataFrame:
    """doc_id: each id of a document marked as of quality 1, once."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def marked(docs: DataFrame, trusted: DataFrame | Iterable[int], bit_words: int = BIT_WORDS) -> DataFrame:
    """trusted (true or null) and text of every row of ``docs`` (doc_id, text); rows of no id match none.

    Rows whose id sets a bit that no trusted id sets stay where they are; ids are compared for the others.
    """
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(i,) for i in trusted], "doc_id long").distinct()
    word = F.pmod(F.xxhash64("doc_id"), F.lit(bit_words)).alias("word")
    bit = F.pmod(F.xxhash64("doc_id", F.lit("bit")), F.lit(64)).cast("int").alias("bit")
    bits = trusted.select(word, bit).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))  # at most bit_words rows
    asked = docs.select("*", word, bit).join(F.broadcast(bits), "word", "left")
    may = F.col("doc_id").isNotNull() & F.coalesce(F.expr("(shiftrightunsigned(bits, bit) & 1L) = 1L"), F.lit(False))
    others = asked.where(~may).select(F.lit(None).cast("boolean").alias("trusted"), "text")
    salted = asked.where(may).select("doc_id", "text", (F.monotonically_increasing_id() % SALTS).alias("salt"))
    every = trusted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("trusted"))
    # Sorted and merged whatever their size: neither side's is bounded, and a merge may spill.
    return others.unionByName(salted.join(every.hint("merge"), ["doc_id", "salt"], "left").select("trusted", "text"))


def gram_counts(docs: DataFrame, trusted: DataFrame | Iterable[int], buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: how many n-grams of all documents and of the trusted ones (distinct ids) hash to each bucket met."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, words = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), WordTable()
        for batch in batches:
            for good, text in zip(batch.column(0), texts_of(batch), strict=True):
                at = (words.features(words.rows((text or "").encode("utf-8", "replace").split())) % np.uint64(buckets)).astype(np.int64)
                count = np.bincount(at, minlength=buckets) if len(at) > buckets // 8 else None
                for sums, wanted in ((raw, True), (target, good.as_py())):
                    if wanted and count is not None:
                        sums += count
                    elif wanted:
                        np.add.at(sums, at, 1)
            del batch  # else it is held while the next one is read
        starts = range(0, buckets, BLOCK)
        task = TaskContext.get().partitionId() // NEIGHBOURS
        lists = [pa.array([x[i : i + BLOCK] for i in starts], pa.list_(pa.int64())) for x in (raw, target)]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([task] * len(starts), pa.int64()), *lists], ["start", "tasks", "raw", "target"])

    rows = marked(id_and_text(docs), trusted).mapInArrow(run, "start long, tasks long, raw array<long>, target array<long>")
    near = rows.groupBy("start", "tasks").applyInArrow(added, rows.schema)
    every = near.groupBy("start").applyInArrow(added, rows.schema)
    counts = every.select("start", F.posexplode(F.arrays_zip("raw", "target")).alias("at", "n"))
    return counts.select((F.col("start") + F.col("at")).alias("bucket"), "n.raw", "n.target").where("raw > 0")


def added(rows: pa.Table) -> pa.Table:
    """One row: arrays of the same length, added."""
    sums = [pa.array([c.combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)], pa.list_(pa.int64())) for c in (rows["raw"], rows["target"])]
    return pa.table([rows["start"][:1], rows["tasks"][:1], *sums], rows.column_names)


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw by bucket; all zero where there is no trusted text."""
    sums = np.zeros((2, buckets))
    for r in counts.collect():  # at most one row a bucket
        sums[:, r["bucket"]] = r["raw"], r["target"]
    if not sums[1].any():
        return np.zeros(buckets)
    p = (sums + smoothing) / (sums.sum(axis=1, keepdims=True) + smoothing * buckets)
    return np.log(p[1]) - np.log(p[0])


def statistics(data: bytes, text: str, rows: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, given its words' rows."""
    n = len(rows)
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n > 3:
        r = np.unique(rows, return_inverse=True)[1].astype(np.int64)
        size = np.int64(r.max() + 1)
        pair = r[:-1] * size + r[1:]
        if int(size) ** 3 >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        _, at, count = np.unique(pair[:-1] * size + r[2:], return_inverse=True, return_counts=True)
        twice = count[at] > 1
        covered = np.zeros(n, bool)
        for j in range(3):
            covered[j : n - 2 + j] |= twice
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


FIELDS = [*((c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("llr", T.DoubleType())]


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` (which has doc_id and text) with the statistics, llr and verdict of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        words, table = WordTable(), sent.value
        buckets = np.uint64(len(table))

        def of(text: str | None) -> tuple:
            text = text or ""
            data = text.encode("utf-8", "replace")
            rows = words.rows(data.split())
            grams = words.features(rows)
            llr = float(table[(grams % buckets).astype(np.int64)].mean()) if len(grams) else 0.0
            counts = statistics(data, text, rows)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
            return *counts, failed, not failed and llr >= threshold, llr

        return of

    return per_row(docs, make, FIELDS, keep)


def quality_rules(docs: DataFrame, trusted: DataFrame | Iterable[int], threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and llr of every row of ``docs`` (doc_id, text; others are ignored).

    A null or empty text has no words, llr 0 and fails the base rules; repeated rows count and return as often as they
    stand; an empty table gives an empty one. Without trusted documents every llr is 0, so that the base rules decide; an
    llr of exactly the threshold is kept. A null doc_id is never trusted. A text's length isn't bounded, but one text is
    handled by one task.
    """
    docs = id_and_text(docs)
    return judge(docs, log_ratios(gram_counts(docs, trusted, buckets), buckets), threshold)
