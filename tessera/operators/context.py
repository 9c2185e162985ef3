"""Bounded source context around hits: windows of lines, merged and cut to a budget, with their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import rollups, search
from tessera.sources.lines import meet
from tessera.sources.shared import stored

FILE = ("query_id", "repo", "path")


def merged(windows: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """keys, start_line, end_line: windows that overlap or touch are one."""
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start_line") > before + 1), 1).otherwise(0)
    runs = windows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "_run").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("_run")


def budgeted(windows: DataFrame, most: int | Column, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Merged windows in line order until ``most`` lines of a file are spent; the last one is cut."""
    most = F.lit(most) if isinstance(most, int) else most
    w = Window.partitionBy(*keys).orderBy("start_line").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1).over(w), F.lit(0))
    left = windows.withColumn("_left", most - spent).where("_left > 0")
    return left.withColumn("end_line", F.least(F.col("end_line"), F.col("start_line") + F.col("_left") - 1)).drop("_left")


def preferred(symbols: DataFrame) -> DataFrame:
    """Symbols that stand for their file: those declared exported, else the public ones, else all; at most four constants."""
    by_file = Window.partitionBy("repo", "path")
    explicit = F.ltrim("signature").startswith("export ")
    level = F.when(F.max(explicit).over(by_file), explicit).when(F.max("exported").over(by_file), F.col("exported")).otherwise(F.lit(True))
    kept = symbols.withColumn("_keep", level).where("_keep").drop("_keep")
    order = Window.partitionBy("repo", "path", F.col("kind") == "constant").orderBy("line", "name", "symbol_id")
    return kept.withColumn("_n", F.row_number().over(order)).where("kind <> 'constant' OR _n <= 4").drop("_n")


def windows_of(hits: DataFrame, files: DataFrame, symbols: DataFrame, around: int, most: int) -> DataFrame:
    """query_id, repo, path, start_line, end_line of each hit (kind, line, end_line), within its file's line_count."""
    h = hits.join(files.select("repo", "path", "line_count"), ["repo", "path"]).where("line_count > 0")
    text_hits = h.where("kind = 'text'").select(*FILE, F.greatest(F.lit(1), F.col("line") - around).alias("start_line"), F.least(F.col("line_count"), F.col("line") + around).alias("end_line"))
    at = symbols.groupBy("repo", "path", F.col("line").alias("_l")).agg(F.min_by("end_line", F.struct("name", "symbol_id")).alias("own_end"), F.count("*").alias("_n"))
    s = h.where("kind = 'symbol'").alias("h").join(at.alias("a"), (F.col("h.repo") == F.col("a.repo")) & (F.col("h.path") == F.col("a.path")) & (F.col("h.line") == F.col("_l")), "left")
    start = F.greatest(F.lit(1), F.col("h.line") - min(around, 2))
    own = F.coalesce("h.end_line", "own_end", F.when(F.col("_n").isNotNull(), F.col("h.line") + around))
    end = F.when(own.isNull(), F.least(F.col("line_count"), F.col("h.line") + around)).otherwise(F.least(F.col("line_count"), F.greatest(own, F.col("h.line")), start + most - 1))
    symbol_hits = s.select("h.query_id", "h.repo", "h.path", start.alias("start_line"), F.greatest(start, end).alias("end_line"))
    f = h.where("kind = 'file'").select(*FILE, "line_count").distinct()
    p = preferred(symbols).select("repo", "path", F.col("line").alias("_l"), F.col("end_line").alias("_e"))
    both = f.join(p, ["repo", "path"], "left")
    end = F.when(F.col("_l").isNull(), F.least(F.col("line_count"), F.lit(most))).when(F.col("_e").isNull(), F.least(F.col("line_count"), F.col("_l") + around)).otherwise(F.least(F.col("line_count"), F.greatest("_e", "_l"), F.col("_l") + most - 1))
    file_hits = both.select(*FILE, F.coalesce("_l", F.lit(1).cast("long")).alias("start_line"), F.greatest(F.coalesce("_l", F.lit(1).cast("long")), end).alias("end_line"))
    return text_hits.unionByName(symbol_hits).unionByName(file_hits)


def context_pack(hits: DataFrame, files: DataFrame, symbols: DataFrame, lines: DataFrame, limit: int = 10, max_files: int = 5, around: int = 4, most: int = 80, include_tests: bool = True, by: tuple[str, ...] = search.GROUP) -> DataFrame:
    """query_id, repo, path, start_line, end_line, hit_lines, content: snippets of the first files that a query's hits are in.

    ``hits`` are those of ``lookup`` with position; files go by their first hit. Lines that aren't indexed are blank. Hits
    and files are counted for each query and repository, or as ``by`` says.
    """
    around, most = search.clamp(around, 0, 20), search.clamp(most, 1, 500)
    if not include_tests:
        hits = hits.where(~paths.is_test(F.col("path"), "context"))
    hits = stored(search.ranked(hits.withColumnRenamed("position", "_at"), ["_at"], search.clamp(limit, 1, 100), by=by), "hits")  # a short list, read several times
    first = hits.groupBy(*FILE).agg(F.min("position").alias("_first"))
    kept = search.ranked(first, ["_first"], search.clamp(max_files, 1, 20), "file_rank", by)
    hits = hits.join(kept.select(*FILE, "file_rank"), [*FILE])
    bounds = budgeted(merged(windows_of(hits, files, symbols, around, most)), most)
    inside = bounds.alias("b").join(hits.select(*FILE, "line", "position").alias("h"), [F.col(f"b.{k}") == F.col(f"h.{k}") for k in FILE] + [F.col("h.line").between(F.col("b.start_line"), F.col("b.end_line"))], "left")
    numbered = inside.groupBy(*[f"b.{k}" for k in FILE], "b.start_line", "b.end_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("h.position", "h.line"))), lambda x: x["line"]).alias("hit_lines"))
    return with_content(numbered, lines)


def workspace_pack(hits: DataFrame, files: DataFrame, symbols: DataFrame, lines: DataFrame, **limits) -> DataFrame:
    """As ``context_pack`` for the hits of ``lookup.workspace_lookup``, over all repositories together."""
    return context_pack(hits, files, symbols, lines, **limits, by=("query_id",))


def with_content(snippets: DataFrame, lines: DataFrame) -> DataFrame:
    """``snippets`` with content: their lines by number, blank where none is indexed."""
    at = lines.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("content").alias("_c"))
    met = meet(snippets, at, F.col("start_line"), F.col("end_line"), "_l", "left")
    held = met.groupBy(*snippets.columns).agg(F.map_from_entries(F.collect_list(F.when(F.col("_l").isNotNull(), F.struct("_l", "_c")))).alias("m"))
    whole = F.array_join(F.transform(F.sequence(F.col("start_line").cast("long"), F.col("end_line").cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), "\n")
    return held.withColumn("content", whole).drop("m")


def totals(snippets: DataFrame) -> DataFrame:
    """query_id, files, lines, tokens of a query's snippets, joined by line ends."""
    return snippets.groupBy("query_id").agg(
        F.count_distinct(F.struct("repo", "path")).alias("files"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"), joined_tokens().alias("tokens")
    )


def joined_tokens() -> Column:
    return text.token_estimate(F.sum(F.length("content")) + F.count("*") - 1).cast("long")


def pack_totals(hits: DataFrame, snippets: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, hit_count, candidate_files, selected_files, selected_lines, estimated_tokens, estimated_saved_tokens.

    Saved is, over all repositories, what reading all files takes less a query's snippets and its hits' descriptions.
    """
    n = hits.groupBy("query_id", "repo").agg(F.count("*").alias("results"))
    per_repo = snippets.groupBy("query_id", "repo").agg(F.count_distinct("path").alias("returned_files"), joined_tokens().alias("tokens"))
    whole = files.groupBy("repo").agg(F.count("*").alias("candidate_files"), F.sum(rollups.file_tokens(F.col("line_count"))).cast("long").alias("all_tokens"))
    rows = hits.select("query_id").distinct().crossJoin(whole)  # a row a query and repository
    rows = rows.join(n, ["query_id", "repo"], "left").join(per_repo, ["query_id", "repo"], "left").na.fill(0)
    saved = rollups.saved_tokens(F.col("all_tokens"), F.col("tokens"), F.col("results"))
    sums = rows.groupBy("query_id").agg(F.sum("results").alias("hit_count"), F.sum("candidate_files").alias("candidate_files"), F.sum(saved).cast("long").alias("estimated_saved_tokens"))
    own = totals(snippets).withColumnsRenamed({"files": "selected_files", "lines": "selected_lines", "tokens": "estimated_tokens"})
    return sums.join(own, "query_id", "left").na.fill(0)


def compact(snippets: DataFrame, repos: DataFrame) -> DataFrame:
    """query_id, payload (JSON), bytes: a query's snippets, each naming its repository by repo_index in ``repos`` (repo, repo_index)."""
    rows = snippets.join(repos.select("repo", "repo_index"), "repo")
    one = F.struct("repo_index", "path", "start_line", "end_line", "hit_lines", "content")
    return payloads(rows, one)


def payloads(rows: DataFrame, one: Column) -> DataFrame:
    """query_id, payload, bytes: a query's rows as one JSON array, in their own order, and its length in UTF-8."""
    packed = rows.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))  # a bounded pack
    return packed.withColumn("bytes", F.octet_length("payload").cast("long"))


def batch(snippets: DataFrame, repos: DataFrame, queries: DataFrame) -> DataFrame:
    """form, payload, bytes of a whole batch: snippets by query, or each once with references to it, whichever is shorter.

    Queries (query_id, query) that differ in case only share the snippets of the first of them.
    """
    first = Window.partitionBy(F.lower(F.trim("query"))).orderBy("query_id")
    same = queries.withColumn("as", F.first("query_id").over(first)).select("query_id", "as")
    used = snippets.withColumnRenamed("query_id", "as").join(same, "as").drop("as").join(repos.select("repo", "repo_index"), "repo")
    plain = F.to_json(F.array_sort(F.collect_list(F.struct("query_id", "repo_index", "path", "start_line", "end_line", "hit_lines", "content"))))
    once = used.groupBy("repo_index", "path", "start_line", "end_line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_lines")))).alias("hit_lines"), F.first("content").alias("content"), F.array_sort(F.collect_set("query_id")).alias("queries"))
    shared = F.to_json(F.array_sort(F.collect_list(F.struct("repo_index", "path", "start_line", "end_line", "hit_lines", "content", "queries"))))
    # One answer of bounded size: a stated batch of queries with at most max_files files each.
    forms = used.agg(plain.alias("payload")).select(F.lit("plain").alias("form"), "payload").unionByName(once.agg(shared.alias("payload")).select(F.lit("shared").alias("form"), "payload"))
    return forms.withColumn("bytes", F.octet_length("payload").cast("long")).orderBy("bytes", "form").limit(1)


def shared_snippets(snippets: DataFrame) -> DataFrame:
    """snippet_id (from 1, by repo, path and lines), hit_lines of all queries and the queries that use each distinct snippet."""
    once = snippets.groupBy("repo", "path", "start_line", "end_line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_lines")))).alias("hit_lines"), F.array_sort(F.collect_set("query_id")).alias("queries"))
    own = once.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy("path", "start_line", "end_line")))
    sizes = once.groupBy("repo").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("repo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a repository
    return own.join(sizes.select("repo", before.alias("_before")), "repo").withColumn("snippet_id", (F.col("_before") + F.col("_n")).cast("long")).drop("_n", "_before")
