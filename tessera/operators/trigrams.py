"""Postings of trigrams by file: which files may hold a text, so that only their lines are searched."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

N = 3
#: Texts up to which names are looked through for each before trigrams of theirs are made.
FEW_TEXTS = 64
#: Trigrams of all queries together up to which a scan of postings is told them.
MOST_GRAMS = 2_000


def grams_of(c: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a shorter one."""
    return grams_of_folded(F.lower(c))


def grams_of_folded(low: Column) -> Column:
    """As ``grams_of``, of a text that is folded already, by whatever rule."""
    return F.array_distinct(runs_of(low))


def runs_of(*low: Column) -> Column:
    """The runs of three characters of texts that are folded already, as often as they stand. Each text is folded once: a
    lambda's own expressions would be evaluated for every run."""
    each = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (N - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(N)))
    return F.flatten(F.transform(F.filter(F.array(*low), lambda t: F.length(t) >= N), each))


def postings(lines: DataFrame) -> DataFrame:
    """repo, path, gram: the distinct trigrams of each file's lines (repo, path, content), in order of gram within a task.

    Written so, a reader that wants some grams only skips most pages.
    """
    return lines.select("repo", "path", F.explode(grams_of(F.col("content"))).alias("gram")).distinct().sortWithinPartitions("repo", "gram")


def candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, repo, path: files that have all trigrams of a query (query_id, query) of three characters or more.

    Such a file may still not hold the query; one that isn't here doesn't.
    """
    each = queries.select("query_id", F.explode(grams_of(F.col("query"))).alias("gram"))
    wanted = [r[0] for r in each.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    if len(wanted) <= MOST_GRAMS:  # few enough to be part of the scan
        index = index.where(F.col("gram").isin(wanted))
    need = each.groupBy("query_id").agg(F.count("*").alias("need"))
    met = index.join(each, "gram").groupBy("query_id", "repo", "path").agg(F.count("*").alias("has"))
    return met.join(need, "query_id").where("has = need").select("query_id", "repo", "path")


def name_grams(rows: DataFrame, keys: tuple[str, ...], *folded: Column) -> DataFrame:
    """keys and gram: the distinct trigrams of short texts of each row, in order of gram within a task, so that few pages of
    each file hold any one. Rows of trigrams aren't shuffled: there are a hundred times as many as names."""
    return rows.select(*keys, F.explode(F.array_distinct(runs_of(*folded))).alias("gram")).sortWithinPartitions("gram", *keys)


def first_grams(asked: DataFrame, held: str) -> tuple[DataFrame, list[str] | None]:
    """``asked`` with the first trigram of its text ``held``, and all of these if they are few enough to be part of a scan."""
    asked = asked.withColumn("gram", F.left(F.col(held), F.lit(N)))
    wanted = [r[0] for r in asked.select("gram").limit(MOST_GRAMS + 1).collect()]
    return asked, sorted(set(wanted)) if len(wanted) <= MOST_GRAMS else None


def holders(names: DataFrame, asked: DataFrame, held: str) -> DataFrame:
    """``names``' keys with the columns of each of ``asked`` whose text ``held`` they may contain: they have its first trigram.

    ``asked`` is a broadcast or not, as it is; each text has three characters and more.
    """
    asked, wanted = first_grams(asked, held)
    if wanted is not None:
        names = names.where(F.col("gram").isin(wanted))
    return names.join(asked, "gram").drop("gram")


def holding(rows: DataFrame, asked: DataFrame, held: str, *folded: Column) -> DataFrame:
    """As ``holders``, but whole ``rows``, by the trigrams of their ``folded`` texts, without an index: only those asked for are made.

    If few texts are asked for, rows that hold none are left out before trigrams of theirs are made.
    """
    few = sorted({r[0] for r in asked.select(held).limit(FEW_TEXTS + 1).collect() if r[0] is not None})
    asked, wanted = first_grams(asked, held)
    if len(few) <= FEW_TEXTS:
        any_of = F.array(*map(F.lit, few)).cast("array<string>")
        rows = rows.where(F.exists(F.array(*folded), lambda t: F.exists(any_of, lambda q: t.contains(q))))
    own = runs_of(*folded)
    own = F.array_distinct(own) if wanted is None else F.array_intersect(own, F.array(*map(F.lit, wanted)).cast("array<string>"))
    return rows.withColumn("gram", F.explode(own)).join(asked, "gram").drop("gram")


def local(rows: list, like: DataFrame) -> DataFrame:
    """A few rows of the driver's as a table that plans hold themselves, so that reading it takes no job."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in like.columns]
    return like.sparkSession.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, like.schema, strict=True)], like.columns))


def update(old: DataFrame, lines: DataFrame, touched: DataFrame) -> DataFrame:
    """``old`` postings with those of touched files (repo, path) replaced by what ``lines`` hold of them."""
    kept = old.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return kept.unionByName(postings(lines.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_semi")).select(*kept.columns))
