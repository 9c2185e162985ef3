"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to; what the driver sees is one row a pattern. The flow
routes words from patterns to source quotas: each pattern has an arc for every repetition of its words, and a later
repetition costs more (convex costs), so words are repeated only where a quota can't be met otherwise. No flow joins
patterns that share no source, directly or by others, so each such group has a flow of its own. A pattern's flow then says
how often its documents are taken: all of them the whole number of times, and for what remains those of least seeded hash,
found by histograms of that hash, so that no pattern's documents have to meet in one task. Documents of the last hash that
fits are told apart by their columns, and equal ones are counted.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Most times that a document is taken, most patterns of a group that has one flow, and most patterns and sources in all.
REPEATS, PATTERNS, ALL_PATTERNS = 3, 20_000, 500_000
#: Equal rows that a task counts off at a time.
RUN = 10_000
#: Bits of the seeded hash, and of those by which each of two histograms cuts.
PLACES, BITS = 60, 12


def quotas(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float, repeats: int = REPEATS) -> dict[str | None, float]:
    """Each source's share of ``total`` by weight, at most ``repeats`` times its size; excess is shared again by weight."""
    target = {s: 0.0 for s in sizes}
    open_, left = {s for s in sizes if weights[s] > 0}, float(total)
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * unit >= repeats * sizes[s]}
        for s in full or open_:
            target[s] = float(repeats * sizes[s]) if full else weights[s] * unit
        left -= sum(target[s] for s in full) if full else left
        open_ -= full or open_
    return target


def groups_of(patterns: Sequence[tuple[frozenset, int]]) -> list[list[int]]:
    """Numbers of the patterns, those together that share a source, directly or by others."""
    leader: dict[str | None, str | None] = {}

    def find(s: str | None) -> str | None:
        while leader.setdefault(s, s) != s:
            leader[s] = s = leader[leader[s]]
        return s

    for members, _ in patterns:
        one, *others = members
        for s in others:
            leader[find(s)] = find(one)
    groups: dict[str | None, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        groups.setdefault(find(next(iter(members))), []).append(i)
    return list(groups.values())


def route(patterns: Sequence[tuple[frozenset, int]], targets: Mapping[str | None, float], repeats: int = REPEATS) -> list[int]:
    """Words that each pattern gives: the flow of each group of patterns that share sources. Larger groups than ``PATTERNS`` raise ValueError."""
    words = [0] * len(patterns)
    for group in groups_of(patterns):
        own = [patterns[i] for i in group]
        names = set().union(*(members for members, _ in own))
        if max(len(own), len(names)) > PATTERNS:
            raise ValueError(f"more than {PATTERNS} membership patterns or sources that overlap")
        for i, f in zip(group, flow(own, {s: targets[s] for s in names}, repeats), strict=True):
            words[i] = f
    return words


def flow(patterns: Sequence[tuple[frozenset, int]], targets: Mapping[str | None, float], repeats: int = REPEATS) -> list[int]:
    """Words that each pattern gives: a flow of least cost among those that meet most of the quotas.

    Successive cheapest paths from patterns' capacity to sources' quotas; the r-th repetition of a word costs r*r, so
    costs grow with each. With one source a pattern this is water filling; with several it moves flow between patterns.
    """
    names = sorted(targets, key=by_code_point)
    index = {s: i for i, s in enumerate(names)}
    n_p, n_s = len(patterns), len(names)
    source, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)

    for i, (members, size) in enumerate(patterns):
        for r in range(repeats):
            arc(source, i, size, r * r)
        for s in sorted(members, key=by_code_point):
            arc(i, n_p + index[s], repeats * size, 0)
    for s in names:
        arc(n_p + index[s], sink, round(targets[s]), 0)
    height = [0] * len(graph)
    while True:  # Dijkstra with potentials; each path fills an arc
        far, via = [float("inf")] * len(graph), [-1] * len(graph)
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in graph[x]:
                if room[e] and (there := d + cost[e] + height[x] - height[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = there, e
                    heapq.heappush(heap, (there, to[e]))
        if via[sink] < 0:
            break
        height = [h + d if d < float("inf") else h for h, d in zip(height, far, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    words = [0] * n_p
    for e in graph[source]:
        words[to[e]] += room[e ^ 1]
    return words


def seeded(seed: int, text: Column | None = None) -> Column:
    """A document's place in its pattern's order: ``PLACES`` bits of a digest of the seed, its id (null: none), its size and its text's digest."""
    told = F.md5(F.coalesce(text if text is not None else F.lit(""), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), told).cast("binary"))
    return F.conv(F.left(digest, F.lit(PLACES // 4)), 16, 10).cast("long")


def cuts(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """pattern, cut, ties, more: the hash at which a pattern's documents, by hash, pass its rest; how many documents have it,
    and how many of those are taken once more, so that the sum is within half a document of the rest.

    Two histograms of ``BITS`` bits lead to the bin where the sum passes the rest. Only that bin's hashes, one in
    2**(2 * BITS) of the pattern, are put in order.
    """
    place = lambda bits: F.shiftright("h", PLACES - bits)  # noqa: E731  bins are in the order of hashes
    upto = lambda by, order: F.sum("s").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    docs = keys.where("size > 0").withColumns({"bin1": place(BITS), "bin2": place(2 * BITS)})
    cut, by = plan.select("pattern", "rest").where("rest > 0"), ["pattern"]
    passed = "upto > rest and upto - s <= rest"
    for bin_ in ("bin1", "bin2"):
        sums = docs.join(F.broadcast(cut), by).groupBy(*by, "rest", bin_).agg(F.sum("size").alias("s")).withColumn("upto", upto(by, bin_))  # at most 2**BITS rows a pattern
        cut, by = sums.where(passed).select(*by, bin_, (F.col("rest") - F.col("upto") + F.col("s")).alias("rest")), [*by, bin_]
    sums = docs.join(F.broadcast(cut), by).groupBy(*by, "rest", "h").agg(F.sum("size").alias("s"), F.max("size").alias("each"), F.count("*").alias("ties")).withColumn("upto", upto(by, "h"))
    fit = F.expr("least(ties, (2 * (rest - upto + s) + each) div (2 * each))")
    return sums.where(passed).select("pattern", F.col("h").alias("cut"), "ties", fit.alias("more"))


def counted_off(tied: DataFrame) -> DataFrame:
    """Rows of a pattern that share the hash at its cut, with once: 1 for the first ``more`` of them and 0 for the others.

    Equal rows are counted and made again, ``RUN`` at a time in any task; different ones go by a hash of their columns.
    """
    kinds = tied.groupBy(*tied.columns).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("pattern").orderBy(F.xxhash64(F.to_json("kept"))).rowsBetween(Window.unboundedPreceding, -1)
    runs = kinds.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")))
    rows = runs.repartition("pattern", "_before", "_run").withColumn("_i", F.explode(F.expr(f"sequence(_run * {RUN} + 1, least(_n, (_run + 1) * {RUN}))")))
    return rows.select(*tied.columns, F.when(F.col("_before") + F.col("_i") <= F.col("more"), 1).otherwise(0).alias("once"))


def pattern_key(sources: Column) -> Column:
    """A digest for each distinct set of sources, whose order and repetitions don't matter; as long for any set."""
    return F.md5(F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s"))).cast("binary"))


def by_code_point(source: str | None) -> tuple[bool, str]:
    """Python compares strings by code point; null goes last."""
    return source is None, source or ""


def default_weights(names: Sequence[str | None]) -> dict[str | None, float]:
    """1, 2, 3, 1, 2, 3, … by code point, null last."""
    ordered = sorted(names, key=by_code_point)
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def mix(docs: DataFrame, sources: Column | None = None, size: Column | None = None, weights: Mapping[str | None, float] | None = None, total: float | None = None, seed: int = 7, keep: tuple[str, ...] = ("doc_id",), repeats: int = REPEATS) -> DataFrame:
    """The columns ``keep`` with size, sources, source_size and target (of the first source by code point) and copies.

    ``sources`` is an array of the sources that a document belongs to (default: its ``source`` alone; null is a source),
    ``size`` a count (default: runs of characters other than ASCII white space in ``text``; null: 0). The target of a
    source is its share of ``total`` (default: all sizes) by weight, at most ``repeats`` times its size. ``copies`` is
    how often a document is taken, 0 to ``repeats``; documents without words are never taken. Rows that are the same in
    id, size, sources and text may be taken a different number of times, one apart, so that a pattern's sum comes within
    half a document of its flow, however often a row stands. Rows with their copies depend on the input's rows and the
    seed only, not on their order. An empty table gives an empty one. The length of a text isn't bounded. Other columns
    are ignored. More than ``ALL_PATTERNS`` patterns or sources raise ValueError, and so do more than ``PATTERNS`` that
    overlap, directly or by others.
    """
    size = size if size is not None else words_of(F.col("text"))
    sources = sources if sources is not None else F.array("source")
    told = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    sized = docs.select(F.struct(*keep).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("size"), sources.cast("array<string>").alias("sources"), told.alias("told"))
    sized = sized.withColumns({"pattern": pattern_key(F.col("sources")), "h": seeded(seed, F.col("told"))}).drop("told", "doc_id")
    keys = stored(sized.select("pattern", "size", "sources", "h"), "mix")
    rows = keys.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size")).limit(ALL_PATTERNS + 1).collect()  # bounded
    rows.sort(key=lambda r: r["pattern"])  # ties in the flow go by pattern
    members = [frozenset(r["sources"] or [None]) for r in rows]
    names = set().union(*members) if members else set()
    if max(len(rows), len(names)) > ALL_PATTERNS:
        raise ValueError(f"more than {ALL_PATTERNS} membership patterns or sources")
    sizes = dict.fromkeys(names, 0)
    for r, m in zip(rows, members, strict=True):
        for s in m:
            sizes[s] += r["size"]
    weights = weights or default_weights(list(names))
    target = quotas(sizes, weights, sum(r["size"] for r in rows) if total is None else total, repeats)
    words = route([(m, r["size"]) for r, m in zip(rows, members, strict=True)], target, repeats)
    first = [min(m, key=by_code_point) for m in members]
    plan = docs.sparkSession.createDataFrame(
        [(r["pattern"], f // r["size"] if r["size"] else 0, f % r["size"] if r["size"] else 0, sizes[s], target[s]) for r, f, s in zip(rows, words, first, strict=True)],
        "pattern string, whole long, rest long, source_size long, target double",
    )
    edges = stored(cuts(keys, plan), "cuts")  # at most one row a pattern, of fixed length
    planned = sized.join(F.broadcast(plan.drop("rest")), "pattern", "left")
    out = planned.join(F.broadcast(edges), "pattern", "left")
    at_cut = F.coalesce((F.col("h") == F.col("cut")) & (F.col("size") > 0), F.lit(False))
    plain = out.where(~at_cut | (F.col("ties") == 1)).withColumn("once", F.when((F.col("h") < F.col("cut")) | (at_cut & (F.col("more") > 0)), 1).otherwise(0)).drop("cut", "ties")
    tied = planned.where("size > 0").join(F.broadcast(edges.where("ties > 1").withColumnRenamed("cut", "h")), ["pattern", "h"]).drop("ties")
    every = plain.unionByName(counted_off(tied))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("once")).otherwise(F.lit(0))
    return every.select("kept.*", "size", "sources", "source_size", "target", copies.cast("int").alias("copies"))


def words_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0))
