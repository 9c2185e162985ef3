"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, found in prefix trees.

Equal sets are one class. A set's n-grams are put in one global order, rarest first as far as a fixed-size count of all
n-grams tells. If two sets are similar, the first 37.5 % of either has several n-grams in common; sets that share too few of
theirs with any other are done. For the others the sets that share an n-gram are a family, named by the least set that
has it, so that sets whose shared n-grams have one leader meet once; similar sets always have a family in common, and
families aren't merged, so none grows by chains. A family's sets are stored in a prefix tree, in which runs of n-grams
that several sets have in common are one edge. Each set walks the tree level by level with the overlap so far, which
all sets below an edge share, and leaves a subtree when even the longest set below it, or what is left of its own, can't
reach the overlap needed, or when all of it is linked to the walker already.

A family of more than ``FAMILY`` sets is dealt over several trees. Some of its sets, picked by hash, are put into each of
them, so copies of one text link through those. Sets that still share n-grams across what has been linked then meet in
trees of two parts each, until every pair that might be similar has met. No step lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.common import MIX, WordHash, id_and_text, rolling, scramble, signed, stored, texts_of
from tessera.llm.components import components

N = 5
#: Sets in one tree, and how many of a larger family are put into each of its trees.
FAMILY, PIVOTS = 128, 32
#: Keys over which the sets of one family are dealt where they are joined to its size.
SALTS = 32
#: n-grams read by one task while those that several sets share are looked for.
TASK_ROWS = 1_500_000
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingles(hashes: WordHash, text: str | None, n: int = N) -> np.ndarray:
    """The distinct hashed n-grams of a text; of fewer words than n, one for the whole; none without words."""
    words = hashes.of((text or "").encode("utf-8", "replace").translate(LOWER).split())
    if not len(words):
        return words
    if len(words) < n:
        return scramble(rolling(words, len(words)) * MIX + np.uint64(len(words)))
    return np.unique(rolling(words, n))


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """What a set of n needs to share with any set to be similar: three quarters, rounded up."""
    return -(-3 * n // 4)


def least_common(n: int) -> int:
    """How many n-grams at least the prefixes of a set of n and of a similar set have in common."""
    return max(1, least_overlap(n) // 8)


def prefix_length(n: int) -> int:
    return n - least_overlap(n) + max(1, n // 8)


def prefixes(docs: DataFrame, counts: np.ndarray, n: int) -> DataFrame:
    """doc_id, tag, cls (hash of the set; null: empty), n, light and heavy: the set's prefix in the global order, in two parts.

    Of the n-grams in ``light`` none is in more than ``sketch.heavy_above`` documents.
    """
    sent, limit = docs.sparkSession.sparkContext.broadcast(counts), sketch.heavy_above(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHash(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cls, size, light, heavy = [], [], [], []
                for text in texts_of(part):
                    grams = shingles(hashes, text, n)
                    size.append(len(grams))
                    cls.append(int(xxhash.xxh3_64_intdigest(grams.tobytes())) - (1 << 63) if len(grams) else None)
                    load = table[sketch.bucket_of(grams)]
                    # Common n-grams go last; among the others any order that is the same everywhere will do.
                    common = load > limit
                    order = np.concatenate([np.flatnonzero(~common), (rest := np.flatnonzero(common))[np.argsort(load[rest], kind="stable")]])[: prefix_length(len(grams)) if len(grams) else 0]
                    light.append(grams[order[~common[order]]])
                    heavy.append(grams[order[common[order]]])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), lists(light), lists(heavy)], ["doc_id", "tag", "cls", "n", "light", "heavy"])

    return docs.mapInArrow(run, "doc_id long, tag long, cls long, n int, light array<long>, heavy array<long>")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(arrays)) if arrays else np.empty(0, np.int64)))


def shared_light(rows: DataFrame) -> DataFrame:
    """Of rows (gram, cls, n) dealt by gram those whose gram two sets or more have, with df and the least cls of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not parts:
            return
        gram, cls, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((cls, gram))
        gram, cls, n = gram[order], cls[order], n[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])])  # equal sets are one
        gram, cls, n = gram[new], cls[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        df = np.diff(np.concatenate([start, [len(gram)]]))
        each = np.repeat(df, df)
        keep = each > 1
        lead = np.repeat(cls[start], df)
        for at in range(0, int(keep.sum()), 100_000):
            i = np.flatnonzero(keep)[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cls[i], n[i], each[i].astype(np.int64), gram[i], lead[i])], ["cls", "n", "df", "gram", "lead"])

    return rows.mapInArrow(run, "cls long, n int, df long, gram long, lead long")


def shared(prefix: DataFrame) -> DataFrame:
    """cls, n, df, gram, lead: the n-grams of each set's prefix that the prefix of another set has too."""
    light = prefix.where("cls is not null").select(F.explode("light").alias("gram"), "cls", "n")
    total = prefix.agg(F.sum(F.size("light"))).first()[0] or 0
    few = shared_light(light.repartition(max(1, -(-total // TASK_ROWS)), "gram"))
    heavy = prefix.where("cls is not null").select(F.explode("heavy").alias("gram"), "cls", "n").groupBy("gram", "cls", "n").agg(F.count("*").alias("_")).drop("_")
    many = heavy.groupBy("gram").agg(F.count("*").alias("df"), F.min("cls").alias("lead")).where("df > 1")
    return few.unionByName(heavy.join(many, "gram").select("cls", "n", "df", "gram", "lead"))


def candidates(shared_grams: DataFrame) -> DataFrame:
    """cls, n, grams, leads of the sets that share enough: of what they share the rarest, which a similar set has one of."""
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 3 / 4) / 8)).cast("int")
    by_set = shared_grams.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "lead"))).alias("s"))  # at most a set's prefix
    first = F.slice("s", F.lit(1), F.size("s") - least + 1)
    return by_set.where(F.size("s") >= least).withColumn("s", first).select("cls", "n", F.col("s.gram").alias("grams"), F.array_distinct(F.col("s.lead")).alias("leads"))


class Tree:
    """Sets of ranks as a prefix tree in arrays; nodes are edges with their lower end, and cover a range of sorted sets."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order = np.array(order, np.int64)
        sets = [sets[i] for i in order]
        lengths = np.array([len(s) for s in sets], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        self.tokens = np.concatenate(sets) if sets else np.empty(0, np.int64)
        lcp = [0]
        for a, b in zip(sets, sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            lcp.append(int(differ[0]) if len(differ) else m)
        lcp = np.array(lcp, np.int64)
        nodes: list[tuple[int, int, int, int, int]] = []  # begin and end in tokens, depth at the end, range of sets
        children: list[list[int]] = [[]]
        stack = [(0, len(sets), 0, -1)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            end = int(lengths[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
            node = len(nodes)
            nodes.append((int(starts[lo]) + depth, int(starts[lo]) + end, end, lo, hi))
            children.append([])
            children[parent + 1].append(node)
            while lo < hi and lengths[lo] == end:
                lo += 1
            if lo < hi:
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)).tolist(), hi]
                stack.extend((a, b, end, node) for a, b in zip(cuts, cuts[1:], strict=False))
        self.begin, self.end, self.depth, self.low, self.high = (np.array(x, np.int64) for x in zip(*nodes, strict=True))
        self.child_at = np.concatenate([[0], np.cumsum([len(c) for c in children])])
        self.child = np.array([c for own in children for c in own], np.int64)
        cover = lambda f, v: np.array([f(v[a:b]) for a, b in zip(self.low, self.high, strict=True)])
        self.longest = cover(np.max, lengths)
        self.sizes = sizes[self.order]
        self.smallest, self.largest = cover(np.min, self.sizes), cover(np.max, self.sizes)
        self.lengths = lengths

    def roots(self) -> np.ndarray:
        return self.child[self.child_at[0] : self.child_at[1]]

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and for each the place of its parent among ``nodes``."""
        a, b = self.child_at[nodes + 1], self.child_at[nodes + 2]
        count = b - a
        ends = np.cumsum(count)
        at = np.repeat(a - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return self.child[at], np.repeat(np.arange(len(nodes)), count)


def linked(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ids that connect what is similar and of different comps; pairs that others connect already may be missing."""
    grams, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, count))] = np.arange(len(grams))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    common = [np.sort(rank[i[count[i] > 1]]) for i in np.split(inverse, cuts)]  # n-grams of one set alone can't count
    live = np.array([i for i, c in enumerate(common) if 4 * len(c) >= 3 * sizes[i]], np.int64)
    if len(live) < 2:
        return []
    tree = Tree([common[i] for i in live], sizes[live])
    own = comps[live][tree.order]
    root = np.unique(own, return_inverse=True)[1].astype(np.int64)  # by sorted set
    links: list[tuple[int, int]] = []
    least = np.array([root[a:b].min() for a, b in zip(tree.low, tree.high, strict=True)])
    most = np.array([root[a:b].max() for a, b in zip(tree.low, tree.high, strict=True)])
    has = np.zeros(len(grams), bool)
    for place in range(len(live)):
        if root.min() == root.max():
            break
        x, n = common[live[tree.order[place]]], tree.sizes[place]
        has[x] = True
        nodes, overlap, joined = tree.roots(), np.zeros(len(tree.roots()), np.int64), False
        while len(nodes):
            a, b = tree.begin[nodes], tree.end[nodes]
            count_ = b - a
            ends = np.cumsum(count_)
            at = np.repeat(a - (ends - count_), count_) + np.arange(ends[-1])
            sums = np.concatenate([[0], np.cumsum(has[tree.tokens[at]])])
            overlap = overlap + sums[ends] - sums[ends - count_]
            mine = root[place]
            for k in np.flatnonzero(overlap * 7 >= 3 * (n + tree.smallest[nodes])):
                for other in range(tree.low[nodes[k]], tree.high[nodes[k]]):
                    if tree.lengths[other] != tree.depth[nodes[k]]:
                        break  # sets that end here come first
                    if root[other] != mine and overlap[k] * 7 >= 3 * (n + tree.sizes[other]):
                        links.append((int(ids[live[tree.order[place]]]), int(ids[live[tree.order[other]]])))
                        root[root == root[other]] = mine
                        joined = True
            last = np.where(count_ > 0, tree.tokens[np.maximum(b - 1, 0)], -1)
            rest = np.where(count_ > 0, len(x) - np.searchsorted(x, last, side="right"), len(x))
            reach = overlap + np.minimum(rest, tree.longest[nodes] - tree.depth[nodes])
            good = (reach * 7 >= 3 * (n + tree.smallest[nodes])) & (4 * tree.largest[nodes] >= 3 * n) & (3 * tree.smallest[nodes] <= 4 * n)
            good &= ~((least[nodes] == mine) & (most[nodes] == mine))
            nodes, parent = tree.below(nodes[good])
            overlap = overlap[good][parent]
        has[x] = False
        if joined:
            least = np.array([root[a:b].min() for a, b in zip(tree.low, tree.high, strict=True)])
            most = np.array([root[a:b].max() for a, b in zip(tree.low, tree.high, strict=True)])
    return links


def tree_join(sets: DataFrame) -> DataFrame:
    """a, b, a_rep, b_rep: links among sets (grp, cls, comp, n, rep, grams) of one grp, as ``linked`` finds them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("cls")
        grams = [np.frombuffer(g, np.uint64) for g in part["grams"]]
        found = linked(part["cls"].to_numpy(), part["comp"].to_numpy(), part["n"].to_numpy(), grams) if len(part) > 1 else []
        links = pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        rep = part.set_index("cls")["rep"].astype("Int64")
        return links.assign(a_rep=rep.reindex(links["a"]).array, b_rep=rep.reindex(links["b"]).array)

    return sets.groupBy("grp").applyInPandas(run, "a long, b long, a_rep long, b_rep long")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, n, rep, groups, grams (8 bytes each): the whole set of each class in ``wanted`` (cls, n, rep, rep_tag, groups).

    A class' text is that of a row of id rep and text hash rep_tag, so that rows of one id, or of none, don't all meet.
    """
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tag") == F.col("rep_tag"))).select("cls", "n", "rep", "groups", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [shingles(hashes, text, n).tobytes() for text in texts_of(part)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(out, pa.binary())], ["cls", "n", "rep", "groups", "grams"])

    return texts.mapInArrow(run, "cls long, n int, rep long, groups array<string>, grams binary")


def representatives(prefix: DataFrame) -> DataFrame:
    """cls, rep, rep_tag: of the rows of each class the least id, nulls last, and the least text hash that it has."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("r")
    return prefix.where("cls is not null").groupBy("cls").agg(least).select("cls", F.col("r.doc_id").alias("rep"), F.col("r.tag").alias("rep_tag"))


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (with cls) with comp: the component by ``links``, or cls itself."""
    comps = components(links)
    return nodes.join(comps, nodes["cls"] == comps["node"], "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node")


def sized(rows: DataFrame) -> DataFrame:
    """``rows`` (cls, fam, …) with m, the size of their family; no task reads all rows of a large one."""
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    counts = rows.groupBy("fam").agg(F.count("*").alias("m")).select("fam", "m", each)
    return rows.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "cls"), F.lit(SALTS)).cast("int")).join(counts, ["fam", "salt"]).drop("salt")


def links_of(docs: DataFrame, prefix: DataFrame, n: int, family: int) -> DataFrame:
    """a, b, a_rep, b_rep: links between classes that connect all that is similar."""
    found = stored(candidates(shared(prefix)), "candidates")
    fams = found.select("cls", "n", F.explode("leads").alias("fam"))
    members = stored(sized(fams).where("m > 1"), "members")
    parts = F.ceil(F.col("m") / family).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    pivot = (F.col("m") > family) & (F.pmod(F.xxhash64(F.lit("pivot"), "cls"), F.ceil(F.col("m") / PIVOTS)) == 0)
    named = F.transform(F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own)), lambda p: F.concat_ws(":", F.col("fam").cast("string"), p.cast("string")))
    groups = members.groupBy("cls", "n").agg(F.flatten(F.collect_list(named)).alias("groups"))  # at most a set's n-grams
    sets = stored(full_sets(docs, groups.join(representatives(prefix), "cls"), n), "sets")
    links = stored(tree_join(sets.select("cls", F.col("cls").alias("comp"), "n", "rep", F.explode("groups").alias("grp"), "grams")), "links")
    large = stored(labelled(members.where(F.col("m") > family).select("cls", "n").distinct(), links.select("a", "b")), "large")
    if large.isEmpty():
        return links
    # What is still apart in large families meets pair by pair of parts, where it shares an n-gram across components.
    grams = large.join(found.select("cls", "grams"), "cls").select("cls", "n", "comp", F.explode("grams").alias("gram"))
    across = grams.groupBy("gram").agg(F.min("comp").alias("lead"), F.max("comp").alias("other")).where("lead <> other")
    cross = stored(grams.join(across, "gram").select("cls", "n", "comp", "lead").distinct(), "cross")
    if cross.isEmpty():
        return links
    left = cross.select("cls", "n", F.col("comp").alias("was"), F.col("lead").alias("fam"))
    left = sized(left).withColumns({"part": own, "parts": parts})
    pair = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = pair.select("cls", F.col("was").alias("comp"), "n", F.concat_ws(":", F.col("fam").cast("string"), F.least("part", "with").cast("string"), F.greatest("part", "with").cast("string")).alias("grp"))
    return links.unionByName(stored(tree_join(pair.join(sets.select("cls", "rep", "grams"), "cls")), "links"))


def grouped_rows(docs: DataFrame, n: int = N, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, tag, cls, n) of ``docs`` (doc_id, text, tag: a hash of the text), and of each class cls, first and first_id.

    ``first`` is the class of its component that has the least id, nulls last; classes in it agree in it. It comes from
    the components themselves, whose nodes are named and ordered so, and nothing is joined by component.
    """
    counts = sketch.bucket_counts(docs, lambda: (lambda hashes: lambda text: shingles(hashes, text, n))(WordHash()))
    prefix = stored(prefixes(docs, counts, n), "prefixes")
    links = links_of(docs, prefix, n, family)
    node = lambda cls, rep: F.struct(F.col(rep).isNull().alias("none"), F.coalesce(rep, F.lit(0)).cast("long").alias("id"), F.col(cls).alias("cls"))
    comps = components(links.select(node("a", "a_rep").alias("a"), node("b", "b_rep").alias("b")))
    joined = comps.select(F.col("node.cls").alias("of"), F.col("comp.cls").alias("first"), F.when(~F.col("comp.none"), F.col("comp.id")).alias("first_id"))
    classes = representatives(prefix)
    alone = F.col("of").isNull()
    classes = classes.join(joined, classes["cls"] == joined["of"], "left").select("cls", F.coalesce("first", "cls").alias("first"), F.when(alone, F.col("rep")).otherwise(F.col("first_id")).alias("first_id"))
    # Written first, so that the rows of a class of many copies may be split over tasks where they are joined to it.
    return prefix.select("doc_id", "tag", "cls", "n"), stored(classes, "classes")


def with_tag(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tag", F.xxhash64("text"))


def ngram_join(docs: DataFrame, n: int = N, family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: components of documents of Jaccard similarity 0.75 or more.

    Texts are cut at ASCII white space and A-Z lower-cased. A document of fewer than ``n`` words has its whole sequence
    as one shingle; one without words, or a null text, none, and its component is itself. ``component_id`` is the least
    doc_id of the component; null ids are never the least unless there is no other. Repeated rows link with themselves
    and return as often as they stand; rows of one id with different texts are linked as their texts are, one by one.
    Sets and n-grams are compared by 64-bit hashes; a text's length isn't bounded. Other columns are ignored; an empty
    table gives an empty one.
    """
    rows, classes = grouped_rows(with_tag(id_and_text(docs)), n, family)
    out = rows.join(classes, "cls", "left").withColumn("n_shingles", F.col("n").cast("long"))
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, family: int = FAMILY) -> DataFrame:
    """The rows of ``docs`` with one of each component: that of least id, nulls last, then of least text hash.

    Rows without words, or of a null text, belong to no component and stay, as often as they stand. Of rows that are equal
    in id and text one is one row. All columns are kept.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, classes = grouped_rows(with_tag(id_and_text(docs)), n, family)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    # Copies are one row each before they meet by component.
    once = rows.where("cls is not null").groupBy("cls", "doc_id", "tag").agg(F.count("*").alias("times")).groupBy("cls").agg(F.min(F.struct(order.alias("o"), "times")).alias("least"))
    stays = once.join(classes, "cls").groupBy("first").agg(F.min("least").alias("least")).select(F.col("least.o.doc_id").alias("s_id"), F.col("least.o.tag").alias("s_tag"), "least.times")
    stays = stored(stays, "stays")
    found = with_tag(keyed).join(stays, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag")))
    single = found.where("times = 1").select("row")
    repeated = found.where("times > 1").dropDuplicates(["doc_id", "tag"]).select("row")
    wordless = keyed.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("row")
    return single.unionByName(repeated).unionByName(wordless).select("row.*")
