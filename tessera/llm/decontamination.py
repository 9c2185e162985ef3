"""Benchmark decontamination: word windows of test items, as hashes in a broadcast table, are looked up in every text.

Items give windows of consecutive words, shorter items one of all their words. The windows, a small table by nature, are
collected as arrays after a check of their size and sent to all tasks; a text's own windows are hashed as it is read, met
hashes are verified word by word, and the words of all verified windows are the text's spans. Texts don't move. A
benchmark beyond the size is cut into blocks by hash, each of which is scanned for by itself, and the blocks' few hits are
put together by text; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import WordHash, grouped, rolling, signed, stored, texts_of
from tessera.llm.licenses import words_of

WINDOW = 10
#: Bytes of windows and item ids that are broadcast at a time.
BLOCK_BYTES = 32_000_000
#: A word of a text as it stands: letters and digits of ASCII, and all characters beyond ASCII.
WORD = regex.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
FILTER_BITS = 20


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """hash, size, words (joined by spaces) and item (id as text, '' for null) of every different window of every item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                found = signed(rolling(hashes.of(words), size)) if size else ()
                for part in grouped(enumerate(found), 100_000):
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([h for _, h in part], pa.int64()), pa.array([size] * n, pa.int32()), pa.array([b" ".join(words[i : i + size]) for i, _ in part], pa.binary()), pa.array([item] * n, pa.string())], ["hash", "size", "words", "item"])

    return items.mapInArrow(run, "hash long, size int, words binary, item string").dropDuplicates(["words", "item"])


class Windows:
    """Windows by hash, in arrays: those of one hash stand together, and those of one window and several items too."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([("size", "ascending"), ("hash", "ascending"), ("words", "ascending"), ("item", "ascending")])
        self.hash, size = rows["hash"].to_numpy().view(np.uint64), rows["size"].to_numpy()
        words = rows["words"].to_pylist()
        self.words, self.items = words, rows["item"].to_pylist()
        #: For each size of window where its rows begin and end; hashes in between are in (signed) order.
        self.sizes = {int(s): (int(np.searchsorted(size, s)), int(np.searchsorted(size, s, "right"))) for s in np.unique(size)}
        self.filter = {s: np.bincount((self.hash[a:b] >> np.uint64(64 - FILTER_BITS)).astype(np.int64), minlength=1 << FILTER_BITS) > 0 for s, (a, b) in self.sizes.items()}

    def find(self, words: list[bytes], hashes: np.ndarray) -> tuple[list[int], list[int], list[str]]:
        """Starts and ends of the text's hit words, joined where they touch, and the items whose windows stand there."""
        covered, items, known = None, set(), {}
        for size, (a, b) in self.sizes.items():
            own = rolling(hashes, size)
            near = np.flatnonzero(self.filter[size][(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(near):
                continue
            asked, table = own[near].view(np.int64), self.hash[a:b].view(np.int64)
            first, last = np.searchsorted(table, asked), np.searchsorted(table, asked, "right")
            for i, x, y in zip(near[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
                run = b" ".join(words[i : i + size])
                if (hit := known.get((size, run))) is None:
                    places = [k for k in range(a + x, a + y) if self.words[k] == run]
                    hit = known[size, run] = bool(places)
                    items.update(self.items[k] for k in places)
                if hit:
                    covered = np.zeros(len(words) + 1, np.int32) if covered is None else covered
                    covered[i] += 1
                    covered[i + size] -= 1
        if covered is None:
            return [], [], []
        edges = np.diff((np.cumsum(covered[:-1]) > 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        return np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), sorted(items)


FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def scanned(docs: DataFrame, windows: pa.Table, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with a column text), n_words, and starts, ends and items of what was found."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    schema = T.StructType([docs.schema[c] for c in keep] + FIELDS.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashes = Windows(sent.value), WordHash()
        for batch in batches:
            counts, found = [], []
            for text in texts_of(batch):
                words = words_of(text)
                counts.append(len(words))
                found.append(table.find(words, hashes.of(words)))
            starts, ends, items = zip(*found, strict=True) if found else ((), (), ())
            lists = [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), *lists], [*keep, *FIELDS.names])

    return docs.mapInArrow(run, schema)


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, n_words, starts and ends of the hit words' spans, and items.

    A window is ``window`` consecutive words of an item, or all words of an item of fewer; a word of a text that stands
    inside any place of any window is hit. Spans are places of words, end exclusive, in order and apart; ``items`` are the
    ids, as text and in order, of items with a window in the text. Null and empty texts and items have no words: no
    windows, no hits. Rows of one item_id are one item; null ids are one item, named ''. Repeated rows of ``docs`` return
    as often as they stand, null ids as they are. A text's length isn't bounded, but one text is handled by one task.
    Other columns are ignored, whatever their names, if ``keep`` doesn't name them; an empty table gives an empty one, an
    empty benchmark no hits.
    """
    windows = stored(item_windows(benchmark, window), "windows")
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    if blocks == 1:
        return scanned(docs, windows.toArrow(), keep)
    docs = docs.withColumn("_key", F.sha2("text", 256))
    found = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == b).toArrow()
        hits = scanned(docs, part, ("_key",)).where(F.size("starts") > 0).dropDuplicates(["_key"]).drop("n_words")
        hits = stored(hits, "hits")
        found = hits if found is None else found.unionByName(hits)

    @F.pandas_udf("starts array<long>, ends array<long>")
    def join_spans(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merged(a.tolist(), b.tolist()) for a, b in zip(starts, ends, strict=True)], columns=["starts", "ends"])

    found = found.groupBy("_key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.withColumn("_spans", join_spans("starts", "ends")).select("_key", "_spans.starts", "_spans.ends", "items")
    counted = scanned(docs, windows.limit(0).toArrow(), (*keep, "_key")).drop("starts", "ends", "items")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return counted.join(found, "_key", "left").select(*keep, "n_words", none("starts", "array<long>"), none("ends", "array<long>"), none("items", "array<string>"))


def without(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans, and what stands between words of one span."""
    places, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, whole: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns and rows, with the hit words cut out of ``text``; with ``whole`` without each text that has any.

    Columns keep their names, order and nulls, whatever they are called; other columns than text aren't changed.
    """
    names = docs.columns
    rows = docs.select("text", F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names))).alias("row"))
    found = benchmark_hits(rows, benchmark, window, ("row", "text"), block_bytes)
    if whole:
        return found.where(F.size("starts") == 0).select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([without(t, a, b) if len(a) else t for t, a, b in zip(text, starts, ends, strict=True)], dtype=object)

    return found.withColumn("_cut", cut("text", "starts", "ends")).select(*((F.col("_cut") if c == "text" else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)))


def hit_digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``, from ``benchmark_hits``."""
    found = benchmark_hits(docs, benchmark, window)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
