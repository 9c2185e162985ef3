"""The driver's tables seen as catalogue relations, so that catalogue operators can run on them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.shared import FORGOTTEN, new_folder, stored

#: Bytes of texts whose lines one task makes, and symbols or files of a task.
TASK_BYTES, TASK_ROWS = 8 << 20, 20_000


_PUBLISHED: dict[tuple, object] = {}
FORGOTTEN.append(_PUBLISHED)


def state_of(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The folder and when the last of its tables was written, so that what replaces a table isn't answered from an older one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    return sf_dir, max((f.getModificationTime() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)), default=0)


def published(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A relation of the catalogue, written once a session into the shared folder, as catalogues are before they are asked."""
    key = (spark.sparkContext.applicationId, *state_of(spark, sf_dir), name)
    if key not in _PUBLISHED:
        _PUBLISHED[key] = stored(make(), name)
    return _PUBLISHED[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by their keys, a bounded number to a task: small rows of which a task of Spark's own reads millions, while
    it makes a hundred trigrams or more of each."""
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), *keys)


def doc_path(doc_id: str = "doc_id") -> str:
    return f"concat(CASE WHEN {doc_id} % 10 = 0 THEN 'tests/' ELSE 'src/' END, 'm', cast({doc_id} % 7 AS string), '/doc_', cast({doc_id} AS string), '.txt')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, language, line_count, size_bytes, content_hash, modified_ns: one file for each document."""
    c = F.col("text")
    make = lambda: read(spark, sf_dir, "documents").select(
        F.expr("concat('r', cast(doc_id % 4 AS string))").alias("repo"),
        F.expr(doc_path()).alias("path"),
        F.col("lang").alias("language"),
        text.line_count(c).cast("long").alias("line_count"),
        F.octet_length(c).cast("long").alias("size_bytes"),
        F.sha2(c, 256).alias("content_hash"),
        F.col("doc_id").alias("modified_ns"),
    )
    return published(spark, sf_dir, "files", make)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content: the texts of the files."""
    return read(spark, sf_dir, "documents").select(F.expr("concat('r', cast(doc_id % 4 AS string))").alias("repo"), F.expr(doc_path()).alias("path"), F.col("text").alias("content"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, line, content: redacted lines that aren't blank."""
    from tessera.sources.lines import indexed_lines

    def make() -> DataFrame:
        total = files(spark, sf_dir).agg(F.sum("size_bytes")).first()[0] or 0
        return indexed_lines(sources(spark, sf_dir).repartition(max(1, -(-total // TASK_BYTES)), "repo", "path"))

    return published(spark, sf_dir, "text_lines", make)


def text_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import trigrams

    return published(spark, sf_dir, "text_grams", lambda: trigrams.postings(text_lines(spark, sf_dir)))


def symbol_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import search

    return published(spark, sf_dir, "symbol_grams", lambda: search.symbol_grams(dealt(symbols(spark, sf_dir), "symbol_id")))


def path_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files of documents and of symbols alike."""
    from tessera.operators import search

    both = lambda: files(spark, sf_dir).select("repo", "path").union(symbol_files(spark, sf_dir).select("repo", "path"))
    return published(spark, sf_dir, "path_grams", lambda: search.path_grams(dealt(both(), "repo", "path")))


def line_index(spark: SparkSession, sf_dir: str):
    """The lines' ``positions.Index``, written once a session."""
    from tessera.operators import positions

    key = (spark.sparkContext.applicationId, *state_of(spark, sf_dir), "line_index")
    if key not in _PUBLISHED:
        folder = new_folder(spark, "line_index")
        positions.write(text_lines(spark, sf_dir), folder)
        _PUBLISHED[key] = positions.read(spark, folder)
    return _PUBLISHED[key]


def function_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols' documents, for queries that are too few to pay for postings."""
    from tessera.operators import bm25

    return bm25.function_documents(symbols(spark, sf_dir), text_lines(spark, sf_dir))


def function_terms(spark: SparkSession, sf_dir: str, stemmed: bool = True) -> DataFrame:
    """The postings of the symbols' documents."""
    from tessera.operators import bm25

    make = lambda: bm25.postings(function_documents(spark, sf_dir), stemmed)
    return published(spark, sf_dir, f"function_terms_{stemmed}", make)


def function_blocks(spark: SparkSession, sf_dir: str, stemmed: bool = True):
    """The ``impacts.Index`` of those postings, written once a session."""
    from tessera.operators import impacts

    key = (spark.sparkContext.applicationId, *state_of(spark, sf_dir), f"function_blocks_{stemmed}")
    if key not in _PUBLISHED:
        _PUBLISHED[key] = impacts.write(function_terms(spark, sf_dir, stemmed), new_folder(spark, "function_blocks"))
    return _PUBLISHED[key]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part, 40 to a file."""
    make = lambda: dealt(read(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "concat('r', cast(p_partkey % 4 AS string)) AS repo",
        "p_partkey AS symbol_id",
        "concat(replace(p_name, ' ', '_'), '_', cast(p_partkey % 40 AS string)) AS name",
        "concat(replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_'), '_', cast(p_partkey % 40 AS string)) AS qualified_name",
        "element_at(array('function', 'class', 'method', 'constant', 'component', 'hook', 'type'), cast(p_partkey % 7 + 1 AS int)) AS kind",
        "concat(CASE WHEN p_partkey % 11 = 0 THEN 'tests/' ELSE 'src/' END, lower(p_type), '/unit_', cast(floor(p_partkey / 40) AS string), '.py') AS path",
        "CAST(p_partkey % 40 * 10 + 1 AS bigint) AS line",
        "CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % 40 * 10 + 1 + p_size % 13 AS bigint) END AS end_line",
        "concat(CASE WHEN p_size % 3 = 0 THEN 'export ' ELSE '' END, lower(p_type), ' ', p_name) AS signature",
        "concat('Makes a ', p_name, ' of kind ', lower(p_type)) AS doc",
        "concat('Makes a ', p_name, ' of kind ', lower(p_type)) AS full_doc",
        "p_size % 2 = 0 AS exported",
    )
    return published(spark, sf_dir, "symbols", make)


def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the symbols are in, of 500 lines each."""
    make = lambda: symbols(spark, sf_dir).select("repo", "path", F.lit("python").alias("language"), F.lit(500).cast("long").alias("line_count")).distinct()
    return published(spark, sf_dir, "symbol_files", make)


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between files of a repository: trees towards the first file, cycles back, packages, and missing files."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    edges = docs.withColumn(
        "to",
        F.expr(
            """filter(array(
                named_struct('id', CASE WHEN doc_id >= 4 THEN (doc_id div 8) * 4 + doc_id % 4 END, 'kind', 'import', 'name', CAST(NULL AS string)),
                named_struct('id', CASE WHEN doc_id >= 4 AND doc_id div 4 % 3 = 0 THEN (doc_id div 12) * 4 + doc_id % 4 END, 'kind', 'require', 'name', CAST(NULL AS string)),
                named_struct('id', CASE WHEN doc_id div 4 % 25 = 1 THEN (doc_id div 4) * 16 + doc_id % 4 END, 'kind', 'import', 'name', CAST(NULL AS string)),
                named_struct('id', CAST(NULL AS bigint), 'kind', 'import', 'name', CASE WHEN doc_id % 6 = 0 THEN concat('pkg_', lang) END)
            ), e -> e.id IS NOT NULL OR e.name IS NOT NULL)"""
        ),
    ).select("doc_id", F.explode("to").alias("e"))
    known = docs.select(F.col("doc_id").alias("known"))
    found = edges.join(known, F.col("e.id") == F.col("known"), "left")
    make = lambda: found.selectExpr(
        "concat('r', cast(doc_id % 4 AS string)) AS repo",
        f"{doc_path()} AS source_path",
        f"coalesce(e.name, {doc_path('e.id')}) AS target_path",
        "coalesce(e.name, concat('./doc_', cast(e.id AS string))) AS import_name",
        "e.kind AS kind",
        "known IS NOT NULL AS resolved",
        "CASE WHEN known IS NOT NULL THEN 'code' WHEN e.name IS NULL THEN 'unresolved' WHEN doc_id % 12 = 0 THEN 'stdlib' ELSE 'external' END AS category",
    )
    return published(spark, sf_dir, "dependencies", make)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS created_at", "event_type AS tool", "concat('p', cast(user_id % 3 AS string)) AS provider", "props AS query",
        "CAST(NULL AS string) AS target_path", "user_id % 9 AS result_count", "user_id % 50 AS candidate_files", "user_id % 7 AS returned_files",
        "CAST(floor(value * 100) AS bigint) AS estimated_saved_tokens",
    )


def task_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each event, with one call: a user's first and second event are a pair's baseline and treatment, and so on."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "value", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n",
    ).selectExpr(
        "concat('u', cast(user_id AS string), '-', cast(n div 2 AS string)) AS pair_id", "CASE WHEN n % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS arm",
        "'m' AS model", "'r' AS revision", "'p' AS prompt_id", "'c' AS config_id", "event_id % 3 <> 0 AS success", "event_id * 7 % 5000 AS elapsed_ms",
        "array(named_struct('provider', 'normalized', 'usage', map('input_tokens', CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 10) AS bigint) END, 'output_tokens', event_id % 97, 'cached_input_tokens', CAST(0 AS bigint), 'cache_write_tokens', CAST(NULL AS bigint)), 'model_calls', CAST(1 AS bigint))) AS calls",
    )


def queries(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """A stated set, as a table that plans hold themselves: how many rows there are is known without a job."""
    return spark.createDataFrame(pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "query": pa.array([r[1] for r in rows], pa.string())}))
