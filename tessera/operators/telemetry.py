"""Usage events: totals, by tool and provider, and the last ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ("estimated_saved_tokens", "candidate_files", "returned_files")


def usage_summary(events: DataFrame) -> DataFrame:
    """tool, provider, events and sums, with a row of nulls for all events: one pass by grouping sets."""
    rows = events.groupingSets([["tool", "provider"], []], "tool", "provider").agg(F.count("*").alias("events"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS), F.grouping_id().alias("_all"))
    return rows.withColumn("total", F.col("_all") > 0).drop("_all")


def recent(events: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` events, latest first."""
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def event_of(files: DataFrame, results: DataFrame, tool: str, provider: str, query: str) -> DataFrame:
    """One event: results (repo, path, a row each), the files there are and returned, and the tokens saved by not reading the others."""
    from tessera.operators import rollups

    saved = rollups.saved_by_paths(files, results).agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("estimated_saved_tokens"))
    asked = files.join(results.select("repo").distinct(), "repo", "left_semi").agg(F.count("*").alias("candidate_files"))
    told = results.agg(F.count("*").alias("result_count"), F.count_distinct(F.struct("repo", "path")).alias("returned_files"))
    row = told.crossJoin(asked).crossJoin(saved)  # three single rows
    head = (F.expr("uuid()").alias("event_id"), F.lit(tool).alias("tool"), F.lit(provider).alias("provider"), F.lit(query).alias("query"), F.lit(None).cast("string").alias("target_path"))
    return row.select(*head, "result_count", "candidate_files", "returned_files", "estimated_saved_tokens")


def record(events: DataFrame, path: str) -> None:
    """Append events, which all get the time of the call unless they have one."""
    stamped = events if "created_at" in events.columns else events.withColumn("created_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)
