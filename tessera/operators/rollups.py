"""Roll-ups over catalogue relations: counts, languages, folders, files, dependencies, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.operators.search import clamp, ranked

#: Estimated tokens of a line of source and of a returned result.
TOKENS_PER_LINE, TOKENS_PER_RESULT = 8, 40


def catalog_counts(files: DataFrame, symbols: DataFrame, dependencies: DataFrame, lines: DataFrame) -> DataFrame:
    """repo, files, symbols, dependencies, text_lines, in one pass over a union of the relations."""
    tagged = [df.groupBy("repo").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in (("files", files), ("symbols", symbols), ("dependencies", dependencies), ("text_lines", lines))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    return rows.groupBy("repo").agg(*(F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("files", "symbols", "dependencies", "text_lines")))


def symbols_by_file(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "path").agg(F.count("*").alias("symbols"))


def file_tokens(lines: Column) -> Column:
    return F.greatest(F.lit(1), lines) * TOKENS_PER_LINE


def file_token_summary(files: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """repo, files, tokens, and of the selected paths (repo, path) selected_files and selected_tokens."""
    marks = selected.select("repo", "path").distinct().withColumn("_in", F.lit(True)) if selected is not None else None
    rows = files.join(marks, ["repo", "path"], "left") if marks is not None else files.withColumn("_in", F.lit(None).cast("boolean"))
    tokens = file_tokens(F.col("line_count"))
    return rows.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum(tokens).cast("long").alias("tokens"), F.count("_in").alias("selected_files"), F.coalesce(F.sum(F.when(F.col("_in"), tokens)), F.lit(0)).cast("long").alias("selected_tokens")
    )


def saved_tokens(total: Column, returned: Column, results: Column) -> Column:
    """Tokens that returning less than all saves, less what the results' descriptions cost; never below zero."""
    return F.greatest(F.lit(0), total - returned - results * TOKENS_PER_RESULT).cast("long")


def saved_by_paths(files: DataFrame, returned: DataFrame) -> DataFrame:
    """repo, saved for results (repo, path): a result a row, though several may name one path."""
    counts = returned.groupBy("repo").agg(F.count("*").alias("results"))
    rows = file_token_summary(files, returned).join(counts, "repo", "left").na.fill(0, ["results"])
    return rows.select("repo", "tokens", "selected_tokens", "results", saved_tokens(F.col("tokens"), F.col("selected_tokens"), F.col("results")).alias("saved"))


def language_summary(files: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """repo, language, files, lines, position: languages of most files first."""
    rows = files.groupBy(*by, "language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))
    return ranked(rows, [F.desc("files"), "language"], 1_000_000, by=by) if by else rows


def directories(files: DataFrame, symbols: DataFrame, depth: int = 2, prefix: str = "") -> DataFrame:
    """repo, directory, depth, files, lines, symbols, languages: what lies below each folder down to ``depth``.

    Depth counts from the prefix, whose own folder isn't among the rows.
    """
    depth, prefix = clamp(depth, 1, 10), prefix.strip().strip("/")
    start = 0 if prefix in ("", ".") else len(prefix.split("/"))
    rows = files.where(paths.below(F.col("path"), prefix)).join(symbols_by_file(symbols), ["repo", "path"], "left")
    above = F.slice(paths.ancestors(F.col("path"), F.lit(start + depth)), start + 1, 100) if start else paths.ancestors(F.col("path"), F.lit(depth))
    each = rows.withColumn("directory", F.explode(above))
    out = each.groupBy("repo", "directory").agg(
        F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"), F.sum(F.coalesce("symbols", F.lit(0))).cast("long").alias("symbols"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages")
    )
    return out.withColumn("depth", (F.size(F.split("directory", "/")) - start).cast("long"))


def tree(files: DataFrame, symbols: DataFrame, depth: int = 2, prefix: str = "", entries: int = 200) -> DataFrame:
    """Folders and files down to ``depth`` in the order depth, path, type; ``truncated`` says whether there were more."""
    depth, start = clamp(depth, 1, 10), len([p for p in prefix.strip("/").split("/") if p and p != "."])
    folders = directories(files, symbols, depth, prefix).select("repo", F.col("directory").alias("path"), F.lit("directory").alias("type"), "depth", "files", "lines", "symbols", "languages")
    level = (F.size(F.split("path", "/")) - start).cast("long")
    leaves = files.where(paths.below(F.col("path"), prefix)).withColumn("depth", level).where(F.col("depth").between(1, depth)).join(symbols_by_file(symbols), ["repo", "path"], "left")
    leaves = leaves.select("repo", "path", F.lit("file").alias("type"), "depth", F.lit(1).cast("long").alias("files"), F.col("line_count").alias("lines"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.col("language").alias("languages"))
    most = clamp(entries, 1, 1000)
    rows = ranked(folders.unionByName(leaves), ["depth", "path", "type"], most + 1, by=("repo",))
    more = rows.groupBy("repo").agg((F.max("position") > most).alias("truncated"))
    return rows.where(F.col("position") <= most).join(more, "repo")


def top_files(files: DataFrame, symbols: DataFrame, limit: int = 10, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """repo, path, symbols, lines, position: files of most symbols, then most lines, then by path."""
    rows = files.join(symbols_by_file(symbols), ["repo", "path"], "left").select("repo", "path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.col("line_count").alias("lines"))
    order = [F.desc("symbols"), F.desc("lines"), *(["repo"] if "repo" not in by else []), "path"]
    return ranked(rows, order, clamp(limit, 1, 100), by=by)


def workspace_outline(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """language, files, lines, symbols, repos over all repositories."""
    rows = files.join(symbols_by_file(symbols), ["repo", "path"], "left")
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"), F.sum(F.coalesce("symbols", F.lit(0))).cast("long").alias("symbols"), F.count_distinct("repo").alias("repos"))


def repo_outline(files: DataFrame, symbols: DataFrame, depth: int = 2, top: int = 20) -> DataFrame:
    """repo, section, position, name, files, lines, symbols, languages: totals, languages, folders and files of most symbols.

    The sections are total, language, directory and file, each in its own order from position 1.
    """
    whole = files.join(symbols_by_file(symbols), ["repo", "path"], "left").groupBy("repo").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"), F.sum(F.coalesce("symbols", F.lit(0))).cast("long").alias("symbols"))
    none, one = F.lit(None), F.lit(1).cast("long")
    folders = ranked(directories(files, symbols, depth), ["depth", "directory"], 1_000_000, by=("repo",))
    row = lambda df, section, position, name, files_, lines, symbols_, languages: df.select("repo", F.lit(section).alias("section"), position.alias("position"), name.cast("string").alias("name"), files_.cast("long").alias("files"), lines.cast("long").alias("lines"), symbols_.cast("long").alias("symbols"), languages.cast("string").alias("languages"))
    c = F.col
    return (
        row(whole, "total", one, none, c("files"), c("lines"), c("symbols"), none)
        .unionByName(row(language_summary(files), "language", c("position"), c("language"), c("files"), c("lines"), none, none))
        .unionByName(row(folders, "directory", c("position"), c("directory"), c("files"), c("lines"), c("symbols"), c("languages")))
        .unionByName(row(top_files(files, symbols, top), "file", c("position"), c("path"), none, c("lines"), c("symbols"), none))
    )


def saved_by_content(files: DataFrame, returned: DataFrame) -> DataFrame:
    """repo, candidate_files, returned_files, saved: what returning snippets saves (repo, returned_files, tokens, results); every repository counts."""
    rows = files.groupBy("repo").agg(F.count("*").alias("candidate_files"), F.sum(file_tokens(F.col("line_count"))).cast("long").alias("all_tokens"))
    rows = rows.join(returned, "repo", "left").na.fill(0, ["returned_files", "tokens", "results"])
    return rows.select("repo", "candidate_files", F.col("returned_files").cast("long").alias("returned_files"), saved_tokens(F.col("all_tokens"), F.col("tokens"), F.col("results")).alias("saved"))


def workspace_savings(files: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, candidate_files, returned_files, saved: over all repositories, for a query's results (query_id, repo, path, a row each)."""
    tokens = file_tokens(F.col("line_count"))
    whole = files.groupBy("repo").agg(F.count("*").alias("candidate_files"), F.sum(tokens).cast("long").alias("all_tokens"))
    counts = results.groupBy("query_id", "repo").agg(F.count("*").alias("results"), F.count_distinct("path").alias("returned_files"))
    picked = results.select("query_id", "repo", "path").distinct().join(files.select("repo", "path", tokens.alias("t")), ["repo", "path"]).groupBy("query_id", "repo").agg(F.sum("t").alias("selected"))
    rows = results.select("query_id").distinct().crossJoin(whole).join(counts, ["query_id", "repo"], "left").join(picked, ["query_id", "repo"], "left").na.fill(0)  # a row a query and repository
    rows = rows.withColumn("saved", saved_tokens(F.col("all_tokens"), F.col("selected"), F.col("results")))
    return rows.groupBy("query_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("candidate_files", "returned_files", "saved")))


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    """The symbols of one file by line and name."""
    rows = symbols.where(F.col("path") == path)
    return ranked(rows, ["line", "name", "symbol_id"], 1_000_000, by=("repo", "path"))


CATEGORIES = ("code", "stdlib", "external", "asset", "unresolved")


def dependency_summary(dependencies: DataFrame) -> DataFrame:
    """repo, total, resolved and a count of each category."""
    return dependencies.groupBy("repo").agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), *(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))


def dependency_examples(dependencies: DataFrame, limit: int = 5) -> DataFrame:
    """repo, category, target_path, source_path, import_name, n, position: the most frequent ones that aren't code."""
    rows = dependencies.where("category <> 'code'").groupBy("repo", "category", "target_path", "source_path", "import_name").agg(F.count("*").alias("n"))
    return ranked(rows, [F.desc("n"), "target_path", "source_path", "import_name"], clamp(limit, 1, 100), by=("repo", "category"))
