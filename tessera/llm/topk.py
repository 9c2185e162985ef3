"""Exact top-k search by distributed histogram selection.

The stated queries are cut into blocks of a fixed number of vectors; a block is sent to the tasks, so what is sent has a
proven size. Every row is scored against the block in matrix products, and each task counts its scores in one histogram
a query; Spark adds the histograms. The bin that holds a query's k-th score becomes its next range, until at most ``SLACK``
times k rows are at or above it, among which the k best are (the last steps would only take rows away that the ranking
takes away too), or the range is one score. Ties at that score are cut in the same way by ranges of vec_id. At last the
rows at or above the cut are returned and ranked. All blocks' rows go to one table; what a block costs is its products
with all vectors, beside which starting its jobs is little. Scores are never kept: each round makes
them anew from the packed vectors, so that memory doesn't depend on the number of rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WRITTEN, shared_dir, stored

#: Queries in a block, bins of a histogram, rows of a packed block, and rows scored at once.
QUERIES, BINS, PACK, STEP = 1024, 256, 8192, 2048
#: A query is settled when at most so many times k rows are at or above its cut.
SLACK = 8
SCALE = 1024


#: Components of this size and more, when scaled, are kept as digits; all others are 64-bit integers that doubles hold exactly.
EXACT = float(2**53)
VALUES = "ids binary, values binary, dimensions int, large boolean"


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), also where that is beyond what a double holds; scale is a power of two."""
    return math.floor(x * scale) if abs(x) < EXACT else int(x) * scale


def unpacked(ids: bytes, values: bytes, d: int, large: bool) -> tuple[np.ndarray, np.ndarray]:
    """The ids and vectors of a pack; large components are Python's integers."""
    ids_ = np.frombuffer(ids, "<i8")
    rows = np.array([int(v) for v in values.split()], object) if large else np.frombuffer(values, "<i8")
    return ids_, rows.reshape(-1, d)


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pack: int = PACK) -> DataFrame:
    """ids, values, dimensions, large: blocks of at most ``pack`` vectors, each component floor(scale * x).

    Values are 64-bit integers as bytes; vectors with a component of 2**53 or more when scaled stand in blocks of their own,
    whose values are digits. Vectors that are null, empty or hold null or non-finite components are left out, and so are
    null ids.
    """
    usable = F.size("v").cast("int") > 0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat, ids = column.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            ends = np.cumsum(lengths)
            large = np.maximum.reduceat(np.abs(flat), ends - lengths) >= EXACT / scale if len(flat) else np.empty(0, bool)
            for d, big in np.unique(np.stack([lengths, large]), axis=1).T.tolist():  # vectors of one length meet only each other
                rows_of = np.flatnonzero((lengths == d) & (large == big))
                for at in range(0, len(rows_of), pack):
                    part = rows_of[at : at + pack]
                    index = (ends[part] - d)[:, None] + np.arange(d)
                    values = " ".join(str(scaled(x, scale)) for x in flat[index].ravel().tolist()).encode() if big else np.floor(flat[index] * scale).astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([ids[part].astype("<i8").tobytes()]), pa.array([values]), pa.array([int(d)], pa.int32()), pa.array([bool(big)])], ["ids", "values", "dimensions", "large"])

    return rows.mapInArrow(run, VALUES)


def products(queries: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating-point products where these are exact, by Python's integers where 64 bits may not do.

    Only a product of a pair that counts (``counts``) and doesn't fit in 64 bits is an error.
    """
    most_query, d = int(np.abs(queries).max(initial=0)), queries.shape[1]
    wide = np.array([int(m) * most_query * d >= 2**63 for m in np.abs(rows).max(axis=1, initial=0).tolist()], bool) if len(rows) else np.empty(0, bool)
    out = np.zeros((len(queries), len(rows)), np.int64)
    plain = rows[~wide].astype(np.int64) if not wide.all() else np.empty((0, d), np.int64)
    if len(plain):
        own = queries.astype(np.int64) if most_query < 2**63 else None
        if own is None:  # such queries meet plain rows of zeros only
            out[:, ~wide] = 0
        elif most_query * int(np.abs(plain).max(initial=0)) * d < 2**53:
            out[:, ~wide] = (own.astype(np.float64) @ plain.astype(np.float64).T).astype(np.int64)
        else:
            out[:, ~wide] = own @ plain.T
    for at in np.flatnonzero(wide).tolist():
        exact = queries.astype(object) @ rows[at].astype(object)
        fits = np.array([-(2**63) <= x < 2**63 for x in exact.tolist()], bool)
        if (counts[:, at] & ~fits).any():
            raise OverflowError("an inner product beyond 64 bits")
        out[fits, at] = exact[fits].astype(np.int64)
    return out


class Block:
    """Queries of one length: ids, vectors, and for each the cut found so far, by score and then by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n = len(ids)
        self.low, self.high = np.zeros(n, np.int64), np.zeros(n, np.int64)  # the k-th score is in low..high
        self.above = np.zeros(n, np.int64)  # rows over high
        self.tie_low, self.tie_high = np.zeros(n, np.int64), np.zeros(n, np.int64)  # the last tie's id is in this range
        self.tie_above = np.zeros(n, np.int64)  # ties of smaller id than tie_low
        self.open = np.ones(n, bool)  # the score's range is still to be cut
        self.tied = np.zeros(n, bool)  # the id's range is still to be cut
        self.cut_ties = np.zeros(n, bool)  # of the ties at low, only ids up to tie_high return

    def scores(self, blocks: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, scores (a row for each query) and whether a pair counts (a query doesn't meet its own row)."""
        d = self.vectors.shape[1]
        for batch in blocks:
            for ids, values, dims, large in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if dims != d:
                    continue
                row_ids, rows = unpacked(ids, values, d, large)
                for at in range(0, len(rows), STEP):
                    part = row_ids[at : at + STEP]
                    meets = self.ids[:, None] != part[None, :]
                    yield part, products(self.vectors, rows[at : at + STEP], meets), meets


def widths(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    return np.maximum(1, -(-(high - low + 1) // bins))


def ranges(vectors: DataFrame, block: Block) -> DataFrame:
    """query, low, high, n: least and greatest score, number of rows, least and greatest id of the rows that a query meets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        big = np.iinfo(np.int64)
        low, high, count = np.full(n, big.max), np.full(n, big.min), np.zeros(n, np.int64)
        first, last = big.max, big.min
        for ids, scores, counts in block.scores(batches):
            low = np.minimum(low, np.where(counts, scores, big.max).min(axis=1))
            high = np.maximum(high, np.where(counts, scores, big.min).max(axis=1))
            count += counts.sum(axis=1)
            first, last = min(first, int(ids.min())), max(last, int(ids.max()))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, low[at], high[at], count[at], np.full(len(at), first), np.full(len(at), last))], ["query", "low", "high", "n", "first", "last"])

    parts = vectors.mapInArrow(run, "query long, low long, high long, n long, first long, last long")
    return parts.groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def histograms(vectors: DataFrame, block: Block, bins: int) -> DataFrame:
    """query, bin, n over the open range of each unsettled query: of scores, or of the ids of ties at its cut."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_score, by_id = np.flatnonzero(block.open), np.flatnonzero(block.tied)
        counts = np.zeros((len(block.ids), bins), np.int64)
        score_width, id_width = widths(block.low, block.high, bins), widths(block.tie_low, block.tie_high, bins)
        for ids, scores, meets in block.scores(batches):
            for q in by_score:
                s = scores[q][meets[q]]
                s = s[(s >= block.low[q]) & (s <= block.high[q])]
                counts[q] += np.bincount((s - block.low[q]) // score_width[q], minlength=bins)
            for q in by_id:
                i = ids[meets[q] & (scores[q] == block.low[q])]
                i = i[(i >= block.tie_low[q]) & (i <= block.tie_high[q])]
                counts[q] += np.bincount((i - block.tie_low[q]) // id_width[q], minlength=bins)
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["query", "bin", "n"])

    return vectors.mapInArrow(run, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def narrow(block: Block, rows: list, bins: int, k: int, slack: int) -> None:
    """Take each unsettled query's range down to the bin that holds what is looked for."""
    table = np.zeros((len(block.ids), bins), np.int64)
    for r in rows:
        table[r["query"], r["bin"]] = r["n"]
    by_id = np.flatnonzero(block.tied)  # those that become so below have counts of scores yet
    for q in np.flatnonzero(block.open):
        width = widths(block.low[q : q + 1], block.high[q : q + 1], bins)[0]
        down = np.cumsum(table[q, ::-1])
        at = int(np.searchsorted(down, k - block.above[q]))  # bins from the top
        b = bins - 1 - at
        over = int(down[at] - table[q, b])
        top = block.high[q]
        block.low[q] = block.low[q] + b * width
        block.high[q] = min(top, block.low[q] + width - 1)
        total = block.above[q] + int(down[at])
        block.above[q] += over
        if total <= slack * k:
            block.open[q] = False
        elif block.low[q] == block.high[q]:
            block.open[q], block.tied[q], block.cut_ties[q] = False, True, True
    for q in by_id:
        need = k - block.above[q] - block.tie_above[q]
        width = widths(block.tie_low[q : q + 1], block.tie_high[q : q + 1], bins)[0]
        up = np.cumsum(table[q])
        b = int(np.searchsorted(up, need))
        total = block.tie_above[q] + int(up[b])
        block.tie_above[q] += int(up[b] - table[q, b])
        top = block.tie_high[q]
        block.tie_low[q] += b * width
        block.tie_high[q] = min(top, block.tie_low[q] + width - 1)
        if block.above[q] + total <= slack * k or block.tie_low[q] == block.tie_high[q]:
            block.tied[q] = False


def selected(vectors: DataFrame, block: Block) -> DataFrame:
    """query_id, vec_id, score of all rows at or above the cut of each query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores, meets in block.scores(batches):
            keep = meets & (scores >= block.low[:, None])
            keep &= ~(block.cut_ties[:, None] & (scores == block.low[:, None]) & (ids[None, :] > block.tie_high[:, None]))
            q, r = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.ids[q], ids[r], scores[q, r])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def query_blocks(queries: DataFrame, size: int) -> Iterator[Block]:
    """The stated queries, a bounded number at a time."""
    ids: dict[tuple[int, bool], list] = {}
    rows: dict[tuple[int, bool], list] = {}
    for r in queries.toLocalIterator():
        key = r["dimensions"], r["large"]
        for i, v in zip(*unpacked(r["ids"], r["values"], *key), strict=True):
            ids.setdefault(key, []).append(i)
            rows.setdefault(key, []).append(v)
            if len(ids[key]) == size:
                yield Block(np.array(ids.pop(key)), np.array(rows.pop(key)))
    for key in sorted(ids):
        yield Block(np.array(ids[key]), np.array(rows[key]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bins: int = BINS, block_size: int = QUERIES, slack: int = SLACK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of greatest score for each row of ``queries``, ties to smaller ids.

    A row isn't met by the query of the same id. Rows that repeat an id are each met and may each rank. Vectors of other
    lengths than the query's take no part; unusable ones (see ``packed``) neither, on either side. With fewer than ``k``
    rows all are returned. Empty tables give an empty result. Other columns are ignored. Components may have any finite
    size; only a product that doesn't fit in 64 bits, of a query and a row that it meets, is an error.
    """
    spark = vectors.sparkSession
    total = max(1, vectors.count())
    rows = stored(packed(vectors.select(id_col, vector_col).repartition(max(1, -(-total // PACK))), id_col, vector_col), "vectors")
    path = None
    for block in query_blocks(packed(queries.select(id_col, vector_col), id_col, vector_col, pack=64), block_size):
        block.open[:] = False
        few = np.zeros(len(block.ids), bool)
        for r in ranges(rows, block).collect():  # one row a query of the block
            q = r["query"]
            block.low[q], block.high[q], block.tie_low[q], block.tie_high[q] = r["low"], r["high"], r["first"], r["last"]
            few[q] = r["n"] <= slack * k
            block.open[q] = not few[q]
        same = block.open & (block.low == block.high)
        block.open &= ~same
        block.tied, block.cut_ties = same.copy(), same.copy()
        while block.open.any() or block.tied.any():
            narrow(block, histograms(rows, block, bins).collect(), bins, k, slack)  # at most bins rows a query of the block
        path = path or f"{shared_dir(spark)}/tessera/selected-{uuid.uuid4().hex}"
        selected(rows, block).write.mode("append").parquet(path)
    if path is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    WRITTEN.append(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
