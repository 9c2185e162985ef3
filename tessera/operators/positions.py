"""Text search by positions: where every trigram stands, so that a query's lines are found and ranked without their text.

Lines in order of (repo, path, line) are cut into segments of a bounded number of characters, and each trigram has one
sorted list of places in a segment. A query stands where its trigrams stand at their distances, so lists are intersected
from the rarest on and what is left are the query's places, overlapping ones too. Only lines that make a top list are read.

Four tables: ``lines`` (the text, by repository and shard), ``postings`` (by trigram), ``grams`` (all there are) and ``means``
(by repository).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import trigrams

#: Characters and lines of a segment (a longer line is one by itself), segments of a task that are one shard of the text, and
#: segments whose postings one task makes.
SEGMENT_CHARS, SEGMENT_LINES, SHARD, TASK_SEGMENTS = 1 << 20, 4096, 64, 16
#: The trigram whose "places" are the starts of a segment's lines and the end of the last, followed by the lines' lengths.
STARTS = ""
#: Distances that say: any of the query's trigrams will do; these are the bounds of lines.
ANY, BOUNDS = -1, -2
LINES = "repo string, path string, line long, content string, segment long, at int"
POSTINGS = "repo string, segment long, gram string, n int, places array<int>"


@dataclass
class Index:
    lines: DataFrame
    postings: DataFrame
    means: DataFrame
    grams: DataFrame

    @cached_property
    def repos(self) -> int:
        return self.means.count()


def numbered(lines: DataFrame, chars: int = SEGMENT_CHARS, most: int = SEGMENT_LINES) -> DataFrame:
    """``lines`` with segment and at, the line's place in it: both follow the order of path and line in a repository."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, at, size, of = (TaskContext.get().partitionId() << 32) - 1, 0, 0, None
        for batch in batches:
            segments, places = [], []
            for repo, length in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if repo != of or at == most or size + length > chars:
                    segment, at, size, of = segment + 1, 0, 0, repo
                segments.append(segment)
                places.append(at)
                at, size = at + 1, size + length
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(segments, pa.int64()), pa.array(places, pa.int32())], ["repo", "path", "line", "content", "segment", "at"])

    keys = ["repo", "path", "line"]
    rows = lines.select(*keys, "content", F.length("content").alias("_length"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, LINES)


def by_gram(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters ``c``: the distinct trigrams (a row of three) that begin at the places ``at``, these in order of trigram
    and place, and where each trigram's end."""
    held = np.bincount(c.astype(np.int64)) > 0
    chars, of = np.flatnonzero(held), (np.cumsum(held) - 1)[c]
    base = len(chars)
    if base**3 < 1 << 31:  # trigram and place are one number, which sorts several times faster than an index does
        key = (((of[at] * base + of[at + 1]) * base + of[at + 2]) << 32) | at
        key.sort()
        code, places = key >> 32, key & 0xFFFFFFFF
    else:
        code = (of[at] * base + of[at + 1]) * base + of[at + 2]
        order = np.argsort(code, kind="stable")
        code, places = code[order], at[order]
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code)) if len(code) else np.empty(0, np.int64)
    names = code[ends - 1]
    return np.stack([chars[names // base**2], chars[names // base % base], chars[names % base]], axis=1), places, ends


def postings(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """repo, segment, gram, n and places of every trigram of the numbered ``lines``; a line of fewer characters is one gram.

    They are in order of gram within a task, so that few pages of each file hold any one, and aren't shuffled: they are several
    times the text, and to range them by gram would make all of them twice. Segments are dealt to ``tasks``, or as Spark sees fit.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        texts = rows["low"].to_pylist()
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        inside = np.ones(len(c), bool)
        for back in (1, 2):
            inside[np.maximum(starts[1:] - back, 0)] = False  # no gram begins so near a line's end
        names, places, ends = by_gram(c, np.flatnonzero(inside[: max(len(c) - 2, 0)]))
        short: dict[str, list[int]] = {}
        for i, t in zip(starts.tolist(), texts, strict=False):
            if len(t) < trigrams.N:
                short.setdefault(t, []).append(i)
        text_of = ["".join(map(chr, g)) for g in names.tolist()]
        rest = [*short.values(), np.concatenate([starts, rows["length"].to_numpy()])]  # of the lines as they are: folding may change a length
        n = len(text_of) + len(rest)
        offsets = np.concatenate([[0], ends, len(places) + np.cumsum([len(x) for x in rest])]).astype(np.int32)
        values = np.concatenate([places, *rest]).astype(np.int32)
        return pa.table([pa.array([key[0].as_py()] * n), pa.array([key[1].as_py()] * n, pa.int64()), pa.array([*text_of, *short, STARTS]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["repo", "segment", "gram", "n", "places"])

    rows = lines.select("repo", "segment", "at", F.lower("content").alias("low"), F.length("content").alias("length"))
    rows = rows if tasks is None else rows.repartition(tasks, "repo", "segment")
    return rows.groupBy("repo", "segment").applyInArrow(run, POSTINGS).sortWithinPartitions("gram", "repo", "segment")


def mean_lengths(lines: DataFrame) -> DataFrame:
    """repo, mean_length: how many trigrams a line has on average."""
    return lines.groupBy("repo").agg((F.sum(F.greatest(F.length("content") - 2, F.lit(0))) / F.count("*")).alias("mean_length"))


def shard_of(segment: Column) -> Column:
    """The folder of a segment's text: some tens of MB that one task wrote."""
    return F.concat(F.shiftright(segment, 32), F.lit("-"), F.floor(segment % (1 << 32) / SHARD))


def write(lines: DataFrame, folder: str) -> None:
    """Write the index of ``lines`` (repo, path, line, content) below ``folder``; lists of places are stored as differences."""
    numbered(lines).withColumn("shard", shard_of(F.col("segment"))).write.partitionBy("repo", "shard").parquet(f"{folder}/lines")
    own = lines.sparkSession.read.schema(LINES).parquet(f"{folder}/lines")
    segments = own.select("repo", "segment").distinct().count()
    postings(own, max(1, -(-segments // TASK_SEGMENTS))).write.option("parquet.writer.version", "PARQUET_2_0").parquet(f"{folder}/postings")
    lines.sparkSession.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("gram") != STARTS).select("gram").distinct().write.parquet(f"{folder}/grams")
    mean_lengths(own).coalesce(1).write.parquet(f"{folder}/means")


def read(spark, folder: str) -> Index:
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return Index(table("lines", LINES + ", shard string"), table("postings", POSTINGS), table("means", "repo string, mean_length double"), table("grams", "gram string"))


def served(query: Column) -> Column:
    """Which queries the postings can answer: three characters and more, or fewer that are plain ASCII and no wildcards."""
    return (F.length(query) >= trigrams.N) | query.rlike(r"^[\x00-\x7F&&[^%_\\]]+\z")


def wanted_grams(index: Index, queries: DataFrame, any_short: bool = True) -> DataFrame:
    """query_id, gram, distance of every trigram of a query in its place; for a short query all trigrams that hold it, at ``ANY``."""
    low = F.lower("query")
    places = F.transform(F.sequence(F.lit(1), F.length(low) - (trigrams.N - 1)), lambda i: F.struct(F.substr(low, i, F.lit(trigrams.N)).alias("gram"), (i - 1).alias("distance")))
    long = queries.where(F.length(low) >= trigrams.N).select("query_id", F.explode(places).alias("g")).select("query_id", "g.gram", "g.distance")
    if not any_short:
        return long
    short = queries.where(F.length(low) < trigrams.N).select("query_id", low.alias("_q"))
    held = index.grams.join(F.broadcast(short), F.col("gram").contains(F.col("_q")))
    return long.unionByName(held.select("query_id", "gram", F.lit(ANY).alias("distance")))


def places_of(index: Index, queries: DataFrame, short: bool = True, most_grams: int = trigrams.MOST_GRAMS, repos: DataFrame | None = None) -> DataFrame:
    """query_id, repo, segment, at, tf, length: the lines that hold each of the ``served`` queries (query_id, query), and how often.

    ``short`` tells whether any query may have fewer than three characters; ``repos`` (query_id, repo), if given, where to
    look for each.
    """
    wanted = wanted_grams(index, queries, short)
    rows = wanted.limit(most_grams + 1).collect()
    lists = index.postings
    need = Counter(r["query_id"] for r in rows)
    if len(rows) <= most_grams:  # few enough to be part of the scan
        lists = lists.where(F.col("gram").isin(sorted({r["gram"] for r in rows} | {STARTS})))
        like = wanted.withColumn("need", F.lit(0).cast("long"))
        wanted = F.broadcast(trigrams.local([(*r, need[r["query_id"]]) for r in rows] + [(q, STARTS, BOUNDS, n) for q, n in need.items()], like))
    else:
        each = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
        wanted = wanted.join(each, "query_id").unionByName(each.select("query_id", F.lit(STARTS).alias("gram"), F.lit(BOUNDS).alias("distance"), "need"))
    met = lists.join(wanted, "gram")
    if repos is not None:
        met = met.join(F.broadcast(repos) if len(need) * index.repos <= most_grams else repos, ["query_id", "repo"], "left_semi")
    # A segment that lacks one of a query's trigrams is out before its lists are looked at.
    found = met.groupBy("query_id", "repo", "segment").agg(F.collect_list(F.struct("n", "distance", "places")).alias("lists"), F.first("need").alias("need"), F.min(F.when(F.col("distance") > BOUNDS, F.col("distance"))).alias("_kind"))
    found = found.where(((F.size("lists") == F.col("need") + 1) & (F.col("_kind") >= 0)) | (F.col("_kind") == ANY)).drop("need", "_kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("query_id", "repo", "segment", "lists")]
            for i in range(batch.num_rows):
                found = columns[3][i].values
                n, distance = (found.field(k).to_numpy() for k in ("n", "distance"))
                ends, values = found.field("places").offsets.to_numpy(), found.field("places").values.to_numpy()
                place = lambda k: values[ends[k] : ends[k + 1]]  # noqa: B023, E731
                order = np.argsort(n, kind="stable")
                order, bounds = order[distance[order] != BOUNDS], place(int(np.flatnonzero(distance == BOUNDS)[0]))
                if distance[order[0]] == ANY:
                    left = np.unique(np.concatenate([place(k) for k in order]))
                else:
                    left = place(order[0]) - distance[order[0]]
                    for k in order[1:]:
                        if not len(left):
                            break
                        other = place(k)
                        near = np.minimum(np.searchsorted(other, left + distance[k]), len(other) - 1)
                        left = left[other[near] == left + distance[k]]
                if not len(left):
                    continue
                first, lengths = bounds[: len(bounds) // 2], bounds[len(bounds) // 2 + 1 :]
                line, tf = np.unique(np.searchsorted(first, left, "right") - 1, return_counts=True)
                for column, value in zip(out, (*([c[i].as_py()] * len(line) for c in columns[:3]), line, tf, lengths[line]), strict=True):
                    column.extend(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "repo", "segment", "at", "tf", "length"])

    return found.mapInArrow(run, "query_id long, repo string, segment long, at int, tf long, length long")
