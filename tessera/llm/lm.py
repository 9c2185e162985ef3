"""Language-model scores: stupid backoff over trigram counts of the corpus, computed relationally.

Documents are packed into blocks of a bounded number of characters. A block explodes into its distinct n-grams of orders
1 to 3 as 64-bit hashes, each with how often the block has it, and deals them to parts of the hash space. A part adds up
what all blocks sent: that is its piece of the count tables. The count of every n-gram that a block asked for is joined
back to the block, in the order in which it asked, where each word's backed-off score is looked up and documents summed.

An n-gram leaves a block once, however often it stands there, so neither a frequent n-gram nor a frequent document makes
a part or a block large. Sorted hashes travel as differences, cut into planes of equal bytes, which compress.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, id_and_text, rolling, stored, texts_of

BACKOFF, SEEN = 0.4, 2
#: Characters of a block's texts (a longer text is a block of its own), and n-grams that all blocks send to a part.
BLOCK_CHARS, PART_GRAMS = 12_000_000, 3_000_000
ORDERS = (1, 2, 3)
#: A block's distinct n-grams are counted in this share of the hash space, 1 in 2 to the power of it; a smaller block's in all of it.
COUNTED_SHARE, COUNTED_WHOLE = 4, 100_000


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, all first bytes, then all second bytes and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.uint64)


def deltas(ordered: np.ndarray) -> bytes:
    return planes(np.diff(ordered, prepend=np.uint64(0)))


def from_deltas(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def gathered(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[bytes]]]:
    """ids and texts of neighbouring rows, about ``chars`` characters at a time."""
    size, ids, texts = 0, [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if size and size + len(text or "") > chars:
                yield ids, texts
                size, ids, texts = 0, [], []
            ids.append(doc_id)
            texts.append((text or "").encode("utf-8", "replace"))
            size += max(1, len(text or ""))
    if ids:
        yield ids, texts


def blocks(docs: DataFrame, chars: int) -> DataFrame:
    """block, ids, lengths (bytes of each text), texts (compressed) and digest (of all): neighbouring rows of ``docs``, about ``chars`` characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, (ids, texts) in enumerate(gathered(batches, chars)):
            lengths, packed = [len(t) for t in texts], zstandard.compress(b"".join(texts), 6)
            digest = xxhash.xxh3_64_intdigest(repr((ids, lengths)).encode() + packed) - (1 << 63)
            row = [[first + i], [ids], [lengths], [packed], [digest]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64()), strict=True)], ["block", "ids", "lengths", "texts", "digest"])

    return docs.mapInArrow(run, "block long, ids array<long>, lengths array<int>, texts binary, digest long")


def sent(docs: DataFrame, chars: int) -> int:
    """How many n-grams the blocks of ``docs`` send in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, n = WordHash(), 0
        for _, texts in gathered(batches, chars):
            n += sent_by(Words(hashes, np.array([len(t) for t in texts]), b"".join(texts)))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return docs.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class Words:
    """The words of a block's texts, as hashes in one array, and its n-grams."""

    def __init__(self, hashes: WordHash, lengths: np.ndarray, data: bytes):
        at, words = 0, []
        for n in lengths.tolist():
            words.append(hashes.of(data[at : at + n].split()))
            at += n
        self.counts = np.array([len(w) for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        ends = np.cumsum(self.counts)
        #: How many words stand before each in its text, as far as n-grams reach.
        self.before = np.minimum(np.arange(len(self.words)) - np.repeat(ends - self.counts, self.counts), ORDERS[-1]).astype(np.int8)

    def ends(self, order: int) -> np.ndarray:
        """Places of the words that end an n-gram of this order."""
        return np.flatnonzero(self.before >= order - 1)

    def grams(self, order: int) -> np.ndarray:
        """The n-gram that ends at each of ``ends``."""
        return rolling(self.words, order)[self.ends(order) - (order - 1)]


def sent_by(words: Words) -> int:
    """How many distinct n-grams of all orders a block has; of many they are counted in a share of the hash space, times its inverse."""
    n = 0
    for order in ORDERS:
        grams = words.grams(order)
        share = COUNTED_SHARE if len(grams) > COUNTED_WHOLE else 0
        n += len(np.unique(grams[grams <= np.uint64((1 << (64 - share)) - 1)])) << share
    return n


def part_bounds(grams: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of the hash space begins among sorted hashes, and the end."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def asked(packed: DataFrame, parts: int) -> DataFrame:
    """part, block, digest and, for each order, grams (distinct, sorted) and times: what a block has in a part of the hash space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for i in range(batch.num_rows):
                words = Words(hashes, batch.column(2)[i].values.to_numpy(), zstandard.decompress(batch.column(3)[i].as_py()))
                columns = []
                for order in ORDERS:
                    grams, times = np.unique(words.grams(order), return_counts=True)
                    cuts = part_bounds(grams, parts)
                    columns.append([deltas(grams[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
                    columns.append([planes(times[a:b] - 1) for a, b in zip(cuts, cuts[1:], strict=False)])
                block, digest = (pa.array([batch.column(k)[i].as_py()] * parts, pa.int64()) for k in (0, 4))
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), block, digest, *(pa.array(c, pa.binary()) for c in columns)], ["part", "block", "digest", *(f"{c}{k}" for k in ORDERS for c in ("grams", "times"))])

    return packed.mapInArrow(run, "part int, block long, digest long, " + ", ".join(f"grams{k} binary, times{k} binary" for k in ORDERS))


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """block, digest, part and, for each order, how often the corpus has each n-gram that the block asked the part for."""

    def run(table: pa.Table) -> pa.Table:
        out = [table.column(c) for c in ("block", "digest", "part")]
        for order in ORDERS:
            asked_ = [from_deltas(g.as_py()) for g in table.column(f"grams{order}")]
            times = np.concatenate([from_planes(t.as_py()) for t in table.column(f"times{order}")]).astype(np.int64) + 1
            grams, at = np.unique(np.concatenate(asked_), return_inverse=True)
            sums = np.zeros(len(grams), np.int64)
            np.add.at(sums, at, times)
            ends = np.cumsum([len(a) for a in asked_])
            out.append(pa.array([planes(c - 1) for c in np.split(sums[at], ends[:-1])], pa.binary()))
        return pa.table(out, ["block", "digest", "part", *(f"counts{k}" for k in ORDERS)])

    return rows.repartition(parts, "part").groupBy("part").applyInArrow(run, "block long, digest long, part int, " + ", ".join(f"counts{k} binary" for k in ORDERS))


def summed(packed: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_words, known (sum of the log scores that need no corpus size) and open (words that need it) of each text."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        if answers.column("digest").unique().to_pylist() != block.column("digest").to_pylist():
            raise RuntimeError("the rows of a block changed while it was counted: write the documents to a table first")
        words = Words(WordHash(), block.column("lengths")[0].values.to_numpy(), zstandard.decompress(block.column("texts")[0].as_py()))
        n = len(words.words)
        count = {}
        for order in ORDERS:
            grams, at = np.unique(words.grams(order), return_inverse=True)
            table = np.concatenate([from_planes(c.as_py()) for c in answers.column(f"counts{order}")]).astype(np.int64) + 1
            count[order] = np.zeros(n, np.int64)  # by the place of the last word; 0: there is no such n-gram
            count[order][words.ends(order)] = table[at]
            del grams, at, table
        one, two, three = (count[k] for k in ORDERS)
        previous = lambda c: np.concatenate([np.zeros(min(1, n), np.int64), c[:-1]])  # noqa: E731  the context's count
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(three >= SEEN, np.log(three / previous(two)), np.where(two >= SEEN, np.log(BACKOFF * two / previous(one)), np.log(BACKOFF * BACKOFF * one)))
        open_ = ((three < SEEN) & (two < SEEN)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(words.counts)])
        of_texts = lambda v: np.array([v[a:b].sum() for a, b in zip(ends, ends[1:], strict=False)])
        return pa.table([block.column("ids")[0].values, pa.array(words.counts), pa.array(of_texts(score), pa.float64()), pa.array(of_texts(open_), pa.int64())], ["doc_id", "n_words", "known", "open"])

    return packed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, known double, open long")


def lm_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS, part_grams: int = PART_GRAMS) -> DataFrame:
    """doc_id, n_words, score (mean log score of a word, to six decimals; null without words) of every row of ``docs``.

    A word's score is that of the trigram that it ends, relative to the bigram before it, if the corpus has the trigram
    ``SEEN`` times or more; else that of the bigram, times ``BACKOFF``, by the same rule; else its share of all words,
    times ``BACKOFF`` twice. N-grams don't reach over texts. Null and empty texts have no words; rows that repeat an id, a
    text or both count in the corpus and return as often as they stand; a null id is returned as it is; an empty table
    gives an empty one. Other columns are ignored. A text's length isn't bounded, but one text is handled by one task.
    N-grams are told apart by 64-bit hashes. Blocks follow the order of rows in a task: where that isn't fixed and a lost
    task makes other blocks than those counted, their digests differ and it is an error, never another score.
    """
    docs = id_and_text(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-sent(docs, block_chars) // part_grams))
    tasks = max(1, -(-2 * chars // block_chars))
    packed = blocks(docs, block_chars).repartition(tasks, "block")
    sums = stored(summed(packed, counted(asked(packed, parts), parts).repartition(tasks, "block")), "lm")
    total = sums.agg(F.sum("n_words")).first()[0] or 0
    score = F.when(F.col("n_words") > 0, (F.col("known") - F.col("open") * F.log(F.lit(float(max(1, total))))) / F.col("n_words"))
    return sums.select("doc_id", "n_words", F.round(score, 6).alias("score"))
