"""Readers of lines of JSON: task records, agents' own event streams, query lists, suites; and of foreign symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.functions.text import ascii_lower
from tessera.operators.search import clamp, ranked, sent

TASKS = (
    "pair_id string, arm string, model string, revision string, prompt_id string, config_id string, success boolean, elapsed_ms long, "
    "calls array<struct<provider string, usage map<string,string>, model_calls long>>"
)
AGENTS = ("codex", "hermes", "opencode", "claude")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value of the lines that hold something, numbered within the file as Spark reads it."""
    return spark.read.text(path).where("trim(value) <> ''")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """query: the lines of a file that are neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> '' AND NOT startswith(query, '#')")


def task_records(lines: DataFrame) -> DataFrame:
    """Records of measured tasks (value: JSON). A count that isn't a whole number of JSON is an error, as is broken JSON.

    Counts nested in details get names with a dot.
    """
    r = lines.select(F.from_json("value", TASKS, {"mode": "FAILFAST", "prefersDecimal": "true"}).alias("r")).select("r.*")
    whole = lambda v: F.when(v.isNull() | v.rlike(r"^[0-9]+$"), v.cast("long")).otherwise(F.raise_error(F.lit("usage counts must be nonnegative integers or null")).cast("long"))

    def flat(usage):
        nested = F.map_filter(usage, lambda k, v: v.startswith("{"))
        inner = F.flatten(F.transform(F.map_entries(nested), lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), whole(x["value"]).alias("value")))))
        plain = F.transform(F.map_entries(F.map_filter(usage, lambda k, v: v.isNull() | ~v.startswith("{"))), lambda e: F.struct(e["key"].alias("key"), whole(e["value"]).alias("value")))
        return F.map_from_entries(F.concat(plain, inner))

    calls = F.transform("calls", lambda c: F.struct(c["provider"].alias("provider"), flat(c["usage"]).alias("usage"), F.coalesce(c["model_calls"], F.lit(1)).alias("model_calls")))
    return r.withColumn("calls", calls)


def number(path: str):
    """A count in an event: a whole number, null if absent; anything else is an error."""
    v = F.get_json_object("value", path)
    return F.when(v.isNull() | v.rlike("^[0-9]+$"), v.cast("long")).otherwise(F.raise_error(F.lit("usage counts must be nonnegative integers or null")).cast("long"))


def text_at(path: str):
    return F.get_json_object("value", path)


def agent_usage(events: DataFrame, agent: str) -> DataFrame:
    """run_id, calls (array of the four counts and model_calls), completed, answer of event streams (run_id, event_no, value).

    Streams that lack the events that say what a whole run used are errors: their run has error set and no calls.
    """
    kind, at = text_at("$.type"), F.col("event_no")
    pick = lambda cond, v: F.array_sort(F.collect_list(F.when(cond, F.struct(at.alias("at"), v.alias("v")))))
    values = lambda c: F.transform(c, lambda x: x["v"])
    none = F.lit(None).cast("long")
    usage = lambda i, o, c, w, n=none: F.struct(i.alias("input_tokens"), o.alias("output_tokens"), c.alias("cached_input_tokens"), w.alias("cache_write_tokens"), n.alias("model_calls"))
    if agent == "codex":
        end = kind.isin("turn.completed", "turn.failed")
        u = usage(number("$.usage.input_tokens"), number("$.usage.output_tokens"), number("$.usage.cached_input_tokens"), number("$.usage.cache_write_input_tokens"))
        said = (kind == "item.completed") & (text_at("$.item.type") == "agent_message")
        rows = events.groupBy("run_id").agg(pick(end, u).alias("ends"), F.coalesce(F.bool_and(F.when(end, kind == "turn.completed")), F.lit(False)).alias("completed"), F.max_by(F.when(said, text_at("$.item.text")), F.when(said, at)).alias("answer"))
        return _checked(rows, F.size("ends") > 0, values(F.col("ends")), "missing terminal event")
    if agent == "hermes":
        i, r, w = number("$.input_tokens"), number("$.cache_read_tokens"), number("$.cache_write_tokens")
        done = F.coalesce(text_at("$.completed") == "true", F.lit(False)) & ~F.coalesce(text_at("$.failed") == "true", F.lit(False))
        rows = events.groupBy("run_id").agg(pick(F.lit(True), usage(i + r + w, number("$.output_tokens"), r, w, number("$.api_calls"))).alias("ends"), F.bool_and(done).alias("completed"), F.lit("").alias("answer"))
        return _checked(rows, F.size("ends") == 1, values(F.col("ends")), "expected one usage object")
    if agent == "opencode":
        end = kind == "step_finish"
        i, r, w = number("$.part.tokens.input"), number("$.part.tokens.cache.read"), number("$.part.tokens.cache.write")
        u = usage(i + r + w, number("$.part.tokens.output"), r, w)
        rows = events.groupBy("run_id").agg(
            pick(end, u).alias("ends"), F.max_by(F.when(end, text_at("$.part.reason")), F.when(end, at)).alias("reason"), F.count_if(kind == "step_start").alias("starts"), F.count_if(kind == "error").alias("errors"),
            F.count(F.when(end, text_at("$.part.id"))).alias("ids"), F.count_distinct(F.when(end, text_at("$.part.id"))).alias("distinct_ids"), F.array_join(F.transform(pick(kind == "text", text_at("$.part.text")), lambda x: x["v"]), "\n").alias("answer"),
        )
        rows = rows.withColumn("completed", (F.col("reason") == "stop") & (F.col("errors") == 0))
        good = (F.size("ends") > 0) & F.col("reason").isin("stop", "length", "error") & ((F.col("starts") == 0) | (F.col("starts") == F.size("ends"))) & (F.col("ids") == F.col("distinct_ids"))
        return _checked(rows, F.coalesce(good, F.lit(False)), values(F.col("ends")), "incomplete or repeated steps")
    if agent == "claude":
        end = kind == "result"
        i, r, w = number("$.usage.input_tokens"), number("$.usage.cache_read_input_tokens"), number("$.usage.cache_creation_input_tokens")
        done = (text_at("$.subtype") == "success") & (text_at("$.is_error") == "false")
        rows = events.groupBy("run_id").agg(pick(end, usage(i + r + w, number("$.usage.output_tokens"), r, w)).alias("ends"), F.coalesce(F.bool_or(F.when(end, done)), F.lit(False)).alias("completed"), F.coalesce(F.max(F.when(end, text_at("$.result"))), F.lit("")).alias("answer"))
        return _checked(rows, F.size("ends") == 1, values(F.col("ends")), "expected exactly one result")
    if agent == "paseo":
        raise ValueError("this agent tells its latest usage only, not that of a whole task; read the underlying provider's stream")
    raise ValueError(f"unknown agent {agent}")


def _checked(rows: DataFrame, good, calls, error: str) -> DataFrame:
    good = F.coalesce(good, F.lit(False))
    return rows.select("run_id", F.when(good, calls).alias("calls"), (good & F.col("completed")).alias("completed"), F.coalesce("answer", F.lit("")).alias("answer"), F.when(~good, F.lit(error)).alias("error"))


RECORD_KEYS = ("pair_id", "arm", "model", "revision", "prompt_id", "config_id", "elapsed_ms", "calls")


def native_records(usage: DataFrame, runs: DataFrame) -> DataFrame:
    """Task records of agents' runs: what the run says of itself, and success if it was graded so and completed."""
    rows = runs.join(usage.where("error IS NULL"), "run_id")
    return rows.select(*RECORD_KEYS, (F.col("graded") & F.col("completed")).alias("success"))


def foreign_symbols(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Another index' symbols (file, name, qualified_name, kind, signature, summary, docstring, line, maybe repo) with query_id, rank and position.

    Any of the five texts may hold the query, whose wildcards are live; names that equal it go first, then names and
    qualified names that start with it. ``repo`` is null where the symbols have none.
    """
    q = F.lower(F.trim("query"))
    if "repo" not in symbols.columns:
        symbols = symbols.withColumn("repo", F.lit(None).cast("string"))
    at = lambda c, before="": text.like(F.lower(F.coalesce(F.col(c), F.lit(""))), q, before=before)
    holds = at("name", "%") | at("qualified_name", "%") | at("signature", "%") | at("summary", "%") | at("docstring", "%")
    rank = F.when(F.lower("name") == q, 0).when(at("name"), 1).when(at("qualified_name"), 2).otherwise(3)
    rows = symbols.join(sent(queries.select("query_id", "query")), holds).withColumn("rank", rank).drop("query")
    return ranked(rows, ["rank", "file", "line", "name"], clamp(limit, 1, 100))


def foreign_sources(symbols: DataFrame, meta: DataFrame, repos: DataFrame) -> DataFrame:
    """``symbols`` (source, …) with the repository that each source is of: the one (repo, root) whose root its meta names.

    ``meta`` has source, key and value; a source of no repository is left out, and of several for one the least.
    """
    plain = lambda c: F.regexp_replace(c, "/+$", "")
    named = meta.where("key = 'source_root'").select("source", plain(F.col("value")).alias("root"))
    owned = named.join(repos.select("repo", plain(F.col("root")).alias("root")), "root").groupBy("repo").agg(F.min("source").alias("source"))
    return symbols.join(owned, "source").drop("source")


def foreign_stats(symbols: DataFrame, meta: DataFrame) -> DataFrame:
    """symbols, files and a map of the index' own meta data."""
    known = meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))  # a few rows
    return symbols.agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files")).crossJoin(known)  # one row each


def normal_queries(c: Column) -> Column:
    """An array of queries, trimmed, without blank and repeated ones; case counts."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


CONFIG_VERSION = 1


def configs(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """name, repos, file and ``fields`` of each JSON file in a folder; a file without a name is named by its own.

    A file without schema_version is of version 0 and read as one of the present version is, defaults filled in; one of a
    later version, or without repositories, is an error. Files stay as they are.
    """
    rows = spark.read.schema(f"name string, repos array<string>, schema_version long, {fields}").option("multiLine", True).json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.json$", "")
    version = F.coalesce("schema_version", F.lit(0))
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.col("file"))).cast("array<string>")
    repos = normal_queries(F.coalesce("repos", F.array().cast("array<string>")))
    checked = F.when(~version.between(0, CONFIG_VERSION), told("unsupported configuration schema")).when(F.size(repos) == 0, told("no repositories")).otherwise(repos)
    return rows.select(F.lower(F.trim(F.coalesce("name", stem))).alias("name"), checked.alias("repos"), "file", *(f.split()[0] for f in fields.split(", ")))


def workspaces(spark: SparkSession, path: str) -> DataFrame:
    """name, repos, file of each named group of repositories in a folder."""
    return configs(spark, path, "description string").drop("description")


def workspace_repos(spark: SparkSession, path: str | None = None, name: str | None = None, roots: list[str] | None = None) -> DataFrame:
    """repo (a label), root, repo_index of a named workspace's repositories and then of further ones, each once, in order."""
    found = list(roots or [])
    if name is not None:
        row = workspaces(spark, path).where(F.col("name") == name.strip().lower()).first()
        if row is None:
            raise FileNotFoundError(f"no workspace {name} in {path}")
        found = [*row["repos"], *found]
    found = list(dict.fromkeys(r.rstrip("/") for r in found))
    if not found:
        raise ValueError("no repositories")
    rows = spark.createDataFrame(list(enumerate(found)), "repo_index long, root string")
    return rows.select(paths.label(F.col("root")).alias("label"), "root", "repo_index")


def suites(spark: SparkSession, path: str) -> DataFrame:
    """name, repos, symbol_queries, workflow_queries and limits of each suite in a folder."""
    rows = configs(spark, path, "symbol_queries array<string>, workflow_queries array<string>, limit long, repeat long")
    empty = F.array().cast("array<string>")
    distinct = lambda c: normal_queries(F.coalesce(F.col(c), empty))
    return rows.select("name", "repos", distinct("symbol_queries").alias("symbol_queries"), distinct("workflow_queries").alias("workflow_queries"), F.coalesce("limit", F.lit(20)).alias("limit"), F.coalesce("repeat", F.lit(3)).alias("repeat"))


def lower_key(c: str):
    return ascii_lower(F.col(c))
