"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

``catalogue_build`` makes the published tables (files, lines, symbols, edges, postings) from the raw ones; the other
queries read them, as queries of a catalogue do, and are warmed up once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import search
from tessera.plans import catalogue
from tessera.sources import adapters

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "catalog_counts", "directory_rollup", "top_files", "dependency_summary", "usage_by_tool", "symbol_fuzzy", "symbol_variants", "file_search", "text_search_ranked", "text_context",
    "text_search_indexed", "references_exact", "bm25_topk", "lookup_blend", "snippet_pack", "transitive_closure", "blast_risk_topk", "related_tests", "snapshot_diff", "incremental_upsert", "paired_report",
)


def catalogue_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    adapters._PUBLISHED.clear()
    for make in (adapters.files, adapters.symbols, adapters.dependencies, adapters.text_lines, adapters.line_index, adapters.symbol_grams, adapters.path_grams):
        make(spark, sf_dir)
    return adapters.function_terms(spark, sf_dir, stemmed=False)


_NAMES: list[tuple[int, str]] = []


def symbol_batch(spark: SparkSession, sf_dir: str, n: int = 100) -> DataFrame:
    """A batch of queries in one plan: names of the symbols themselves, which are made up before the clock runs (at warm-up)."""
    if not _NAMES:
        _NAMES.extend((i, r["name"]) for i, r in enumerate(adapters.symbols(spark, sf_dir).select("name").distinct().orderBy("name").limit(n).collect()))
    return search.symbol_prefixes(adapters.symbols(spark, sf_dir), adapters.queries(spark, _NAMES), 10)


def seconds(make, spark: SparkSession, sf_dir: str) -> float:
    began = time.perf_counter()
    make(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {"catalogue_build": catalogue_build} | {name: catalogue.QUERIES[name] for name in HEADLINE} | {"symbol_batch_100": symbol_batch}
    took = {}
    for name, make in runs.items():
        seconds(make, spark, SF_DIR)  # warm-up
        took[name] = round(seconds(make, spark, SF_DIR), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({
        "metric": "sum of seconds over the headline queries, each after one warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "batch_queries_per_second": round(100 / took["symbol_batch_100"], 1), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
