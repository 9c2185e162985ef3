"""Merkle manifest of a dataset: a digest of every row, of every group's rows and of the whole, and each row's proof.

Rows of a group stand in order and are numbered without gathering a group: rows are dealt by ranges, counted by range, and
counts are added up. Then level by level a window over (group, parent's index), with a frame of the whole run, collects
the run's digests in order: they are both what the parent is the digest of and the siblings of each child. One row of
each run stands for the parent in the next level, so levels shrink, and each is a table. Proofs go the other way: a level
takes the proof of its parents and puts its own siblings before it, so a leaf is joined once, not once a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

ARITY = 3
#: The columns of a leaf, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """A value as text that can't be mistaken for others: ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: Sequence[Column]) -> Column:
    return digest(*(encoded(c) for c in columns))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column ``grp``) with ``place``, from 0 in each group in the given order, and the group's size ``n``.

    No task holds a group: rows are dealt by ranges of group and order, and a range's first place is the number of the
    group's rows in the ranges before. Only one row for each group and range is added up by group.
    """
    keys = ["grp", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_range", F.shiftright("_at", 33))
    w = Window.partitionBy("grp")
    ranges = dealt.groupBy("grp", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("grp", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n"))
    ranges = stored(ranges, "ranges")  # a row for each range and group that meet
    return dealt.join(ranges, ["grp", "_range"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def levels(leaves: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The tree's levels from below, and for each the groups that have a single node there (grp, digest).

    ``leaves``: grp, place, n and digest, besides what else they hold. A level has, for each node, its parent's place and
    the digests that stand to its left and right in the run, each put together; the last list is one longer than the first.
    """
    tree, single, nodes = [], [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        single.append(nodes.where("n = 1").select("grp", "digest"))
        if most <= 1:
            return tree, single
        nodes = nodes.where("n > 1").withColumn("parent", F.floor(F.col("place") / arity))
        run = Window.partitionBy("grp", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("place") % arity).cast("int")
        joined = lambda a, n: F.array_join(F.slice("_run", a, n), "")
        level = nodes.withColumn("_run", F.collect_list("digest").over(run)).withColumns({"left": joined(F.lit(1), at), "right": joined(at + 2, F.lit(arity)), "up": F.sha2(F.array_join("_run", ""), 256)})
        level = stored(level.drop("_run"), f"{name}-{len(tree)}")
        tree.append(level)
        nodes = level.where(at == 0).select("grp", F.col("parent").alias("place"), F.ceil(F.col("n") / arity).alias("n"), F.col("up").alias("digest"))
        most = -(-most // arity)


STEPS = "array<struct<left:string,right:string>>"


def with_paths(leaves: DataFrame, tree: list[DataFrame], tops: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``leaves``' columns ``keep`` with the group's values and ``steps``, from the leaf's own siblings up to the group's.

    ``tops``: grp, height (the level on which the group is one node), ``steps`` above that, and values of the group.
    """
    values = [c for c in tops.columns if c not in ("grp", "height", "steps")]
    at_height = lambda h: tops.where(F.col("height") == h).select("grp", F.lit(0).cast("long").alias("place"), "steps", *values)
    above = at_height(len(tree))
    for h in range(len(tree) - 1, -1, -1):
        up = above.select(F.col("grp").alias("_g"), F.col("place").alias("_p"), F.col("steps").alias("_s"), *values)
        own = [c for c in keep if h == 0]
        level = tree[h].join(up, (F.col("grp") == F.col("_g")) & (F.col("parent") == F.col("_p")))
        steps = F.concat(F.array(F.struct("left", "right")), F.col("_s")).cast(STEPS)
        level = level.select("grp", "place", steps.alias("steps"), *values, *own)
        if h:
            above = level.unionByName(at_height(h))
    alone = leaves.where("n = 1").join(at_height(0).drop("place"), "grp").select("steps", *values, *keep)
    return level.select("steps", *values, *keep).unionByName(alone) if tree else alone


def merkle_manifest(docs: DataFrame, columns: Sequence[str] = LEAF, group: str = "source", order: str = "doc_id", arity: int = ARITY, keep: dict[str, Column] | None = None) -> DataFrame:
    """The values ``keep`` (name: column over ``docs``) of every row, and leaf, subroot, root and steps (left, right).

    ``leaf`` is the digest of ``columns``, in that order; rows of a group stand by ``order``, then by leaf. ``steps`` are
    the digests beside the row's node, level by level up to the root: ``folded`` takes a leaf through them. Nulls are
    values of their own, of any column: rows of null ``order`` stand first in their group, null ``group`` is the first
    group. Repeated rows are leaves of their own; equal leaves may change places, which changes no digest, but then their
    steps. Empty and very long texts are values as any other. Columns of other names are ignored; the names given to
    ``keep`` may be any but grp, place, n, parent, digest, left, right, up, steps, subroot and root. An empty table gives
    an empty one.
    """
    kept = keep or {}
    names = {f"_k{i}": n for i, n in enumerate(kept)}
    group_key = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(group_key.alias("grp"), F.col(order).alias("_o"), leaf([F.col(c) for c in columns]).alias("digest"), *(c.alias(k) for k, c in zip(names, kept.values(), strict=True)))
    leaves = ranked(rows, ["_o", "digest"]).drop("_o")
    tree, single = levels(leaves, arity, "leaves")
    subroots = None
    for h, one in enumerate(single):
        found = one.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.lit(h).alias("height"), "digest")
        subroots = found if subroots is None else subroots.unionByName(found)
    subroots = stored(ranked(subroots, ["of"]), "subroots")
    above, roots = levels(subroots, arity, "groups")
    top = roots[-1].select("grp", F.lit(len(above)).alias("height"), F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    tops = with_paths(subroots, above, top, ["of", "height", "digest"])
    tops = stored(tops.select(F.col("of").alias("grp"), "height", "steps", F.col("digest").alias("subroot"), "root"), "tops")
    out = with_paths(leaves, tree, tops, ["digest", *names])
    return out.select(*(F.col(k).alias(n) for k, n in names.items()), F.col("digest").alias("leaf"), "subroot", "root", "steps")


def folded(leaf_: Column, steps: Column) -> Column:
    """The root that a leaf leads to beside the given siblings."""
    return F.aggregate(steps, leaf_, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof(steps: Column) -> Column:
    """The digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest_digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``, tampered with in part.

    Where 2 divides the CRC-32 of the decimal doc_id, the text that is checked has lost its line feeds; folded_root is what
    its leaf leads to with the siblings of the untouched table, and verified tells whether that is the root. Rows without
    id aren't tampered with.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, keep={"doc_id": F.col("doc_id"), "seen": leaf([text if c == "text" else F.col(c) for c in LEAF])})
    out = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), folded(F.col("seen"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
