"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the least node that it reaches) for every node of ``edges`` (a, b of any one ordered type, either way round).

    Each round takes every node to the least among itself and its neighbours, and that to where it goes itself; edges are
    then drawn between what nodes were taken to, and equal ones and loops fall away, so the graph shrinks until no edge
    is left. At last the rounds' steps are put together, the smallest first. Edges, steps and labels stay distributed;
    the driver only asks whether any edge is left. Edges of a null end are left out; an empty table gives an empty one.
    """
    ordered = lambda df, a, b: df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left = stored(ordered(edges.select("a", "b"), "a", "b"), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        if len(steps) == most_rounds:
            raise RuntimeError(f"edges are left after {most_rounds} rounds")
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        first = ends.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("up"))
        further = first.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        step = stored(first.join(further, F.col("up") == F.col("_n")).select("node", F.least("up", "_u").alias("up")), "steps")
        steps.append(step)
        of = lambda name, to: step.select(F.col("node").alias(name), F.col("up").alias(to))  # noqa: B023, E731
        left = stored(ordered(left.join(of("a", "x"), "a").join(of("b", "y"), "b"), "x", "y"), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    labels = steps.pop().withColumnRenamed("up", "comp")
    while steps:
        step, later = steps.pop(), labels.select(F.col("node").alias("_n"), "comp")
        labels = step.join(later, step["up"] == later["_n"], "left").select("node", F.coalesce("comp", "up").alias("comp"))
    return labels
