"""Exact references to an identifier, told apart into definitions and uses, with roll-ups by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import search


def references(lines: DataFrame, symbols: DataFrame, queries: DataFrame, limit: int = 50, definitions: bool = True, ignore_case: bool = False) -> DataFrame:
    """query_id, repo, path, line, content, kind, symbol_kind, score: matches of a whole identifier, definitions first.

    Candidates are those of ``text_search`` at 20 times the limit (100 to 500). A candidate's place among all of them is
    its score, 1000 more if it is no definition, so scores have gaps where candidates were left out.
    """
    limit = search.clamp(limit, 1, 200)
    found = search.text_search(lines, queries, max(100, min(500, 20 * limit)))
    same = (lambda c: F.lower(c) == F.lower("query")) if ignore_case else (lambda c: c == F.col("query"))
    found = found.where(text.reference_match(F.col("content"), F.col("query"), ignore_case))
    last = F.substring_index("qualified_name", ".", -1)
    at = symbols.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("name"), last.alias("last"), F.col("kind").alias("of_kind"), "symbol_id")
    here = (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")) & (same(F.col("name")) | same(F.col("last")))
    joined = found.join(at, here, "left").groupBy(*found.columns).agg(F.min_by("of_kind", "symbol_id").alias("of_kind"))
    assigned = text.defines(F.col("content"), F.col("query"), ignore_case)
    joined = joined.withColumn("symbol_kind", F.when(F.col("of_kind").isNotNull(), F.col("of_kind")).when(assigned, "assignment").otherwise(""))
    joined = joined.withColumn("kind", F.when(F.col("symbol_kind") != "", "definition").otherwise("reference"))
    if not definitions:
        joined = joined.where("kind = 'reference'")
    joined = joined.withColumn("score", F.col("position") - 1 + F.when(F.col("kind") == "reference", 1000).otherwise(0)).drop("position")
    out = search.ranked(joined, ["score", "path", "line"], limit)
    return out.select("query_id", "repo", "path", "line", "content", "kind", "symbol_kind", "score")


def workspace_references(lines: DataFrame, symbols: DataFrame, queries: DataFrame, repos: DataFrame, limit: int = 50, per_repo: int = 50, definitions: bool = True, ignore_case: bool = False) -> DataFrame:
    """References over the repositories in ``repos`` (repo, label, repo_index), best of all by score plus index, label, path and line."""
    each = references(lines, symbols, queries, per_repo, definitions, ignore_case).join(repos, "repo")
    each = each.withColumn("score", F.col("score") + F.col("repo_index"))
    return search.ranked(each, ["score", "label", "path", "line"], search.clamp(limit, 1, 200), by=("query_id",)).drop("repo_index")


def by_file(matches: DataFrame) -> DataFrame:
    """query_id, repo, path, match_count, definition_count, reference_count, first_line, last_line, sample_content."""
    return matches.groupBy("query_id", "repo", "path").agg(
        F.count("*").alias("match_count"), F.count_if(F.col("kind") == "definition").alias("definition_count"), F.count_if(F.col("kind") == "reference").alias("reference_count"),
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by("content", "line").alias("sample_content"),
    )
