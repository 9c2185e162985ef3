"""Substring dedup by relative Lempel-Ziv parsing: what passages of other documents, or of the same, cover is removed.

A text is factored greedily against reference blocks: from a word on, a factor is the longest run of words that also
starts anywhere else in a block; the parse goes on where the first window of ``WINDOW`` words stands that reaches over
the factor's end, so that windows across factor boundaries are looked up too. Factors of ``WINDOW`` words or more are
duplicate spans. A block is indexed by the order of all its suffixes, so the longest match of a place is its neighbour's.

To factor every text against every block would be quadratic. Which blocks can hold a match is known from a sparse index:
of the runs of ``RUN`` words in a window the one of least hash is the window's anchor, which equal windows share; one
place in 15 is an anchor. The windows of one anchor's place make a segment of a text, and a block holds the segments of
some anchors from all texts, so a segment's matches are all in the block of its anchor. Anchors that occur once in the
corpus can't be in a window that repeats, and have no segment. Texts that are equal word by word count as one that is
known to repeat. An anchor that occurs more than ``LIGHT`` times doesn't fit a block; its windows meet by hash. Tasks put
equal windows of their own texts together first, so that each sends a window once, in arrays for the parts of the hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, id_and_text, rolling, signed, stored, texts_of

WINDOW, RUN = 35, 8
#: Occurrences of an anchor up to which its segments are in one block, segments of a block, and windows of heavy anchors in a task.
LIGHT, BLOCK_SEGMENTS, TASK_ROWS = 1_000, 60_000, 1_500_000
#: Windows of heavy anchors that a task puts together before it sends them.
HELD_WINDOWS = 500_000


def window_anchors(words: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text: its anchor's hash, and where that run starts."""
    runs = rolling(words, run)
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    span = window - run + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(words) - window + 1)
    return runs[at], at


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def indexed(docs: DataFrame, window: int, run: int) -> DataFrame:
    """doc_id, tag, cls (hash of the words), n, kept (digest of all words), anchors and times: the sparse index of each text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                cls, n, kept, anchors, times = [], [], [], [], []
                for text in texts_of(part):
                    words = (text or "").encode("utf-8", "replace").split()
                    h = hashes.of(words)
                    n.append(len(words))
                    cls.append(int(xxhash.xxh3_64_intdigest(h.tobytes())) - (1 << 63))
                    kept.append(sha(words))
                    value, at = window_anchors(h, window, run)
                    places = np.unique(at)
                    found, count = np.unique(rolling(h, run)[places], return_counts=True) if len(places) else (np.empty(0, np.uint64), np.empty(0, np.int64))
                    anchors.append(found)
                    times.append(count.astype(np.int32))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in ([signed(a) for a in anchors], times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string()), *lists], ["doc_id", "tag", "cls", "n", "kept", "anchors", "times"])

    return docs.mapInArrow(rows, "doc_id long, tag long, cls long, n long, kept string, anchors array<long>, times array<int>")


def repeated_anchors(index: DataFrame, window: int) -> DataFrame:
    """cls, rep, rep_tag, times (rows of that id and text), copies, light, heavy: classes of equal texts with the anchors
    of theirs that occur more than once; a class is read from the row of least id, nulls last, and least text hash."""
    rows = index.where(F.col("n") >= window)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("r")
    classes = rows.groupBy("cls").agg(least, F.count("*").alias("copies"), F.first("anchors").alias("anchors"), F.first("times").alias("times"))
    classes = stored(classes.select("cls", F.col("r.doc_id").alias("rep"), F.col("r.tag").alias("rep_tag"), "copies", "anchors", "times"), "classes")
    each = classes.select("cls", F.explode(F.arrays_zip("anchors", "times")).alias("a")).select("cls", F.col("a.anchors").alias("anchor"), F.col("a.times").alias("times"))
    often = each.groupBy("anchor").agg(F.sum("times").alias("total")).where("total > 1")
    found = each.join(often, "anchor").groupBy("cls").agg(F.collect_list(F.when(F.col("total") <= LIGHT, F.col("anchor"))).alias("light"), F.collect_list(F.when(F.col("total") > LIGHT, F.col("anchor"))).alias("heavy"))  # at most a text's anchors
    return classes.select("cls", "rep", "rep_tag", "copies").join(found, "cls")


def segments(docs: DataFrame, found: DataFrame, window: int, run: int) -> DataFrame:
    """cls, copies, text, its segments (anchor, at: their first word, to: behind their last) and its windows of heavy anchors.

    Of the latter each different one is told once (heavy_at, heavy: its hash, heavy_times); those that the text has more
    than once are found already, and own_a and own_b are the spans that they cover.
    """
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))
    texts = docs.join(found, same).select("cls", "copies", "light", "heavy", "text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last_cls = WordHash(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                out: list[list] = [[] for _ in range(8)]
                take = []
                for i, (cls, text) in enumerate(zip(part.column(0).to_pylist(), texts_of(part), strict=True)):
                    if cls == last_cls:
                        continue  # rows that are equal in id and text follow each other
                    last_cls = cls
                    take.append(i)
                    h = hashes.of((text or "").encode("utf-8", "replace").split())
                    value, place = window_anchors(h, window, run)
                    light, heavy = (np.isin(value, part.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)) for k in (2, 3))
                    first = np.flatnonzero(light & np.concatenate([[True], place[1:] != place[:-1]])[: len(light)])
                    last = np.searchsorted(place, place[first], side="right") - 1  # places only grow
                    at = np.flatnonzero(heavy)
                    prints, which, inverse, times = np.unique(rolling(h, window)[at], return_index=True, return_inverse=True, return_counts=True)
                    twice = at[times[inverse] > 1]
                    own = merged(np.stack([twice, twice + window], axis=1))
                    row = (signed(value[first]), first, last + window, at[which], signed(prints), times, own[:, 0], own[:, 1])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                columns = [pa.array(c, pa.list_(t)) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)]
                kept = part.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4), *columns], ["cls", "copies", "text", *(c.split()[0] for c in lists)])

    lists = ["anchor array<long>", "at array<int>", "to array<int>", "heavy_at array<int>", "heavy array<long>", "heavy_times array<int>", "own_a array<int>", "own_b array<int>"]
    return texts.mapInArrow(rows, ", ".join(["cls long", "copies long", "text string", *lists]))


def with_words(found: DataFrame) -> DataFrame:
    """anchor, cls, copies, at, words: a row a segment, with its words."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                out: tuple[list, ...] = [], [], [], [], []
                for i, text in enumerate(texts_of(part)):
                    words = (text or "").encode("utf-8", "replace").split()
                    anchor, at, to = (part.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (3, 4, 5))
                    row = (anchor, np.full(len(at), part.column(0)[i].as_py(), np.int64), np.full(len(at), part.column(1)[i].as_py(), np.int64), at, [b" ".join(words[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)])
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                flat = [pa.array(np.concatenate(c), t) for c, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*flat, pa.array([w for c in out[4] for w in c], pa.binary())], ["anchor", "cls", "copies", "at", "words"])

    return found.select("cls", "copies", "text", "anchor", "at", "to").where(F.size("anchor") > 0).mapInArrow(rows, "anchor long, cls long, copies long, at int, words binary")


class Reference:
    """A block: segments as one array of word numbers, and the order of the places where a window may start."""

    def __init__(self, parts: list[bytes], window: int):
        numbers: dict[bytes, int] = {}
        sizes = np.array([p.count(b" ") + 1 for p in parts], np.int64)
        words = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for p in parts for w in p.split(b" ")), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        self.begin, self.window = ends - sizes, window
        self.left = np.repeat(ends, sizes) - np.arange(len(words))  # words from a place to its segment's end
        #: At each place the number of the 1, 2, 4, … words from it on, in the words' order; 0 stands after a segment's end.
        self.names, k = {1: words}, 1
        while k < sizes.max(initial=1):
            more = np.zeros(len(words), np.int64)
            inside = np.flatnonzero(self.left > k)
            more[inside] = self.names[k][inside + k]
            self.names[2 * k] = np.unique(self.names[k].astype(np.int64) * (int(more.max(initial=0)) + 1) + more, return_inverse=True)[1].astype(np.int32) + 1
            k *= 2
        places = np.flatnonzero(self.left >= window)
        self.order = places[np.argsort(self.names[k][places], kind="stable")]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from the places a and b on are the same, within their segments."""
        n = np.zeros(len(a), np.int64)
        most = np.minimum(self.left[a], self.left[b])
        for k in sorted(self.names, reverse=True):
            inside = n < most
            i = np.flatnonzero(inside)
            n[i[self.names[k][a[i] + n[i]] == self.names[k][b[i] + n[i]]]] += k
        return np.minimum(n, most)

    def longest(self) -> np.ndarray:
        """For each place the most words from it on that also start at another place where a window may start; else 0."""
        out = np.zeros(len(self.left), np.int64)
        near = self.common(self.order[:-1], self.order[1:])
        out[self.order[:-1]] = near
        out[self.order[1:]] = np.maximum(out[self.order[1:]], near)
        return out


def parse(longest: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The factors (from, to) of at least ``window`` words of a segment, given the longest match of each of its places."""
    found, out, at = np.flatnonzero(longest >= window).tolist(), [], 0
    for i in found:
        if i >= at:
            end = i + int(longest[i])
            out.append((i, end))
            at = end - window + 1  # the first window that reaches over the factor's end
    return out


def factored(rows: DataFrame, tasks: int, window: int) -> DataFrame:
    """cls, a, b: the factors of segments (anchor, cls, copies, at, words) against the block of their anchor.

    Segments of the same words are one in the block, and one factor each. Texts with copies are in blocks for the others'
    sake; they go as a whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, cls, copies, at = [], [], [], []
        for batch in batches:
            for column, i in ((cls, 1), (copies, 2), (at, 3), (parts, 4)):
                column += batch.column(i).to_pylist()
        if not parts:
            return
        own: dict[bytes, int] = {}
        which = [own.setdefault(p, len(own)) for p in parts]
        times = np.bincount(which)
        block = Reference(list(own), window)
        longest, out = block.longest(), []
        for i, k in enumerate(which):
            if copies[i] == 1:
                begin = int(block.begin[k])
                size = int(block.left[begin])
                out += [(cls[i], at[i] + a, at[i] + b) for a, b in ([(0, size)] if times[k] > 1 else parse(longest[begin : begin + size], window))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["cls", "a", "b"])

    return rows.repartition(tasks, "anchor").select("anchor", "cls", "copies", "at", "words").mapInArrow(run, "cls long, a int, b int")


def joined(cls: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cls, a, b: the windows that start at the places ``at`` of texts, those of a text that meet or overlap as one span."""
    order = np.lexsort((at, cls))
    cls, a = cls[order], at[order].astype(np.int64)
    new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (a[1:] > a[:-1] + window)])[: len(a)]
    last = np.concatenate([new[1:], [True]])[: len(a)]
    return cls[new], a[new], a[last] + window


def packed(part: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[pa.ListArray]]:
    """Columns in order of part as one row for each part, of lists."""
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)])
    ends = pa.array(np.concatenate([first, [len(part)]]).astype(np.int32))
    return part[first].tolist(), [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]


def combined(found: DataFrame, parts: int, window: int) -> DataFrame:
    """part, print, cls, a, b (lists): the windows of heavy anchors, of which a task sends each different one once.

    What several texts of about ``HELD_WINDOWS`` windows share is known there, and goes as spans (part -1). Of each
    fingerprint one entry is left for its part: its only window, which may still find its like elsewhere, or a witness
    that there are several (b is 0).
    """

    def flush(held: list[tuple]) -> pa.RecordBatch:
        print_, cls, at, times, single = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(print_, kind="stable")
        print_, cls, at, times, single = (x[order] for x in (print_, cls, at, times, single))
        start = np.flatnonzero(np.concatenate([[True], print_[1:] != print_[:-1]]))
        several = np.add.reduceat(times, start) > 1
        hit = np.repeat(several, np.diff(np.concatenate([start, [len(print_)]]))) & single & (times == 1)  # texts with copies go as a whole, and own spans are known
        known = joined(cls[hit], at[hit], window)
        at = at[start].astype(np.int64)
        rows = [(np.full(len(known[0]), -1), np.zeros(len(known[0]), np.int64), *known)]
        part = ((print_[start].view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows.append(tuple(x[order] for x in (part, print_[start], cls[start], at, np.where(several, 0, at + window))))
        part, *columns = (np.concatenate(x) for x in zip(*rows, strict=True))
        names, lists = packed(part, *columns[:2], *(c.astype(np.int32) for c in columns[2:]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *lists], ["part", "print", "cls", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 128):
                rows = batch.slice(begin, 128)
                size = pc.list_value_length(rows.column(2)).to_numpy(zero_copy_only=False)
                cls, copies = (np.repeat(rows.column(i).to_numpy(), size) for i in (0, 1))
                at, print_, times = (rows.column(i).flatten().to_numpy() for i in (2, 3, 4))
                held.append((print_, cls, at, times * copies, copies == 1))
                n += len(cls)
                if n >= HELD_WINDOWS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    rows = found.where(F.size("heavy") > 0).select("cls", "copies", "heavy_at", "heavy", "heavy_times")
    return rows.mapInArrow(run, "part int, print array<long>, cls array<long>, a array<int>, b array<int>")


def met(rows: DataFrame, window: int) -> DataFrame:
    """cls, a, b: spans of the only windows of ``combined`` rows that another task has too; a fingerprint is all in one part."""

    def run(group: pa.Table) -> pa.Table:
        print_, cls, at, end = (group[c].combine_chunks().flatten().to_numpy() for c in ("print", "cls", "a", "b"))
        order = np.argsort(print_, kind="stable")
        print_, cls, at, end = (x[order] for x in (print_, cls, at, end))
        start = np.flatnonzero(np.concatenate([[True], print_[1:] != print_[:-1]]))
        size = np.diff(np.concatenate([start, [len(print_)]]))
        hit = np.repeat((size > 1) | np.logical_or.reduceat(end == 0, start), size) & (end > 0)
        found = joined(cls[hit], at[hit], window)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["cls", "a", "b"])

    return rows.where("part >= 0").groupBy("part").applyInArrow(run, "cls long, a int, b int")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (from, to; in any order) with those that meet or overlap as one, in order."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:], [True]])]], axis=1)


def spans_of(row) -> np.ndarray:
    """An Arrow list of structs (a, b) as an array of two columns."""
    values = row.values
    return np.stack([values.field(k).to_numpy(zero_copy_only=False) for k in ("a", "b")], axis=1) if values is not None and len(values) else np.empty((0, 2), np.int64)


def left_of(words: list[bytes], spans: np.ndarray) -> list[bytes]:
    return [w for a, b in zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(words)], strict=True) for w in words[a:b]]


def cut(texts: DataFrame) -> DataFrame:
    """cls, n_removed, kept: what is left of each text (cls, text, spans)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = [], [], []
            for i, text in enumerate(texts_of(batch)):
                words = (text or "").encode("utf-8", "replace").split()
                left = left_of(words, merged(spans_of(batch.column(2)[i])))
                for column, x in zip(out, (batch.column(0)[i].as_py(), len(words) - len(left), sha(left)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["cls", "n_removed", "kept"])

    return texts.mapInArrow(rows, "cls long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``.

    Words are runs of characters other than ASCII white space, compared as they are. Removed is each word in a window of
    ``window`` words that also starts anywhere else; windows are judged on the texts as they come. Null and empty texts
    have no words; a text of fewer words than a window loses none. Rows that repeat a text, under one id or several, are
    occurrences of their own; null ids are returned as they are. Windows are compared word by word, those of anchors that
    occur more than ``LIGHT`` times by 64-bit hashes. A text's length isn't bounded. Other columns are ignored; an empty
    table gives an empty one. ``kept_texts`` has the spans and what is left as text.
    """
    docs = tagged(docs)
    index, dup = _duplicates(docs, window, run)
    copies = index.where(F.col("n") >= window).groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1").select("cls", F.lit(True).alias("whole"))
    left = stored(cut(dup), "cut").select("cls", "n_removed", F.col("kept").alias("left"))
    # Written first, so that the rows of a class of many copies may be split over tasks where they are joined to it.
    per_class = stored(copies.join(left, "cls", "full"), "removed")
    out = index.select("doc_id", "cls", "n", "kept").join(per_class, "cls", "left")
    nothing = F.lit(sha([]))
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("left", "kept")).alias("kept_sha256"),
    )


def kept_texts(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, text (the words that are left, joined by one space; null stays null) and spans (from, to in words, removed)."""
    docs = tagged(docs)
    index, dup = _duplicates(docs, window, run)
    copies = index.where(F.col("n") >= window).groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1").select("cls", F.lit(True).alias("whole"))
    spans = stored(dup.select("cls", "spans"), "spans")
    per_class = stored(copies.join(spans, "cls", "full"), "removed")
    per_text = index.select("doc_id", "tag", "cls").distinct().join(per_class, "cls").select(F.col("doc_id").alias("id"), F.col("tag").alias("of"), "whole", "spans")
    texts = docs.join(per_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("of")), "left").select("doc_id", "text", "whole", "spans")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(texts_of(batch)):
                words = (text or "").encode("utf-8", "replace").split()
                gone = np.array([[0, len(words)]]) if batch.column(2)[i].as_py() else merged(spans_of(batch.column(3)[i]))
                left = None if text is None else b" ".join(left_of(words, gone)).decode("utf-8", "replace")
                out.append({"doc_id": batch.column(0)[i].as_py(), "text": left, "spans": [{"from": a, "to": b} for a, b in gone.tolist()]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]))

    return texts.mapInArrow(rows, "doc_id long, text string, spans array<struct<from:long,to:long>>")


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and tag, a hash of the text, by which texts are found again: ids may be null or repeat."""
    return id_and_text(docs).withColumn("tag", F.xxhash64("text"))


def _duplicates(docs: DataFrame, window: int, run: int) -> tuple[DataFrame, DataFrame]:
    """The index of all texts, and (cls, text, spans) of the texts without copies that have duplicate spans."""
    index = stored(indexed(docs, window, run), "index")
    found = stored(segments(docs, repeated_anchors(index, window), window, run), "segments")
    light, heavy = found.agg(F.sum(F.size("anchor")), F.sum(F.size("heavy"))).first()
    factors = stored(factored(with_words(found), max(1, -(-(light or 0) // BLOCK_SEGMENTS)), window), "factors")
    sent = stored(combined(found, max(1, -(-(heavy or 0) // TASK_ROWS)), window), "windows")
    known = sent.where("part < 0").select(F.explode(F.arrays_zip("cls", "a", "b")).alias("s")).select("s.*")
    dealt = known.unionByName(met(sent, window))
    own = found.select("cls", F.explode(F.arrays_zip(F.col("own_a").alias("a"), F.col("own_b").alias("b"))).alias("s")).select("cls", "s.*")
    spans = factors.unionByName(dealt).unionByName(own).groupBy("cls").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # at most a text's words
    return index, found.where("copies = 1").select("cls", "text").join(spans, "cls")
