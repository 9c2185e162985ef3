"""Ranked search over symbols, files and text lines: many queries over many repositories in one plan.

``queries`` (query_id, query) is a stated set. If it has at most ``MOST_QUERIES`` rows, which is checked, it is sent to
the tasks, and every row of the catalogue is scored against it where it lies; a larger one is joined as Spark sees fit.
Names are met by their first characters, text by trigrams where there are postings. Per (query, repository) only bounded
top lists are ranked, which Spark cuts before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import positions, trigrams
from tessera.sources.lines import meet

MOST_QUERIES = 10_000
#: First characters of a name by which it is met.
HEAD = 3
GROUP = ("query_id", "repo")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


def sent(rows: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Queries as a broadcast, after a check that they are few; as they are if they are many.

    ``rows`` may be made of ``queries``, a bounded number of each (variants, terms); these are counted then. Where the plan
    itself says how many rows there are at most, none are counted.
    """
    most = rows._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and most.get() <= MOST_QUERIES:
        return F.broadcast(rows)
    queries = rows if queries is None else queries
    most = queries._jdf.queryExecution().optimizedPlan().maxRows()
    few = most.get() <= MOST_QUERIES if most.isDefined() else queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    return F.broadcast(rows) if few else rows


def ranked(rows: DataFrame, order: list, limit: int | Column, name: str = "position", by: tuple[str, ...] = GROUP) -> DataFrame:
    """The first ``limit`` rows of each group by ``order``, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= limit)


def variants(queries: DataFrame) -> DataFrame:
    """query_id, query, variant, ordinal (from 0); empty ones and repeats, whatever their case, left out.

    A query's variants are an array of at most six, so nothing has to be moved.
    """
    forms = F.filter(text.query_variants(F.trim("query")), lambda v: F.trim(v) != "")
    fresh = F.filter("_forms", lambda v, i: ~F.array_contains(F.transform(F.slice("_forms", F.lit(1), i), F.lower), F.lower(v)))
    return queries.withColumn("_forms", forms).select("query_id", "query", F.posexplode(fresh).alias("ordinal", "variant")).select("query_id", "query", "ordinal", "variant")


def known(asked: DataFrame) -> DataFrame:
    """What is made of a stated set of queries, as a table that plans hold themselves if it is small enough; else as it is.

    Then branches that no query takes aren't part of the plan.
    """
    rows = asked.limit(MOST_QUERIES + 1).collect()
    return trigrams.local(rows, asked) if len(rows) <= MOST_QUERIES else asked


def near(names: DataFrame, asked: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of ``names`` (_name, _qualified_name: folded) and what is asked (``text.with_patterns`` of ``queries``) that may start with them.

    Rows and queries meet by their first characters; only queries that have fewer before a wildcard meet every row.
    """
    head = lambda c: F.left(c, F.lit(HEAD))
    long = F.length("_plain") >= HEAD
    keyed = names.withColumn("_head", F.explode(F.array_distinct(F.array(head("_name"), head("_qualified_name")))))
    by_head = keyed.join(sent(asked.where(long).withColumn("_head", head("_plain")), queries), "_head").drop("_head")
    start = F.col("_name").startswith(F.col("_plain")) | F.col("_qualified_name").startswith(F.col("_plain"))
    return by_head.where(start).unionByName(names.join(sent(asked.where(~long), queries), start))


#: Columns in which a symbol search looks for a part.
SEARCHED = ("name", "qualified_name", "signature", "doc")


def symbol_grams(symbols: DataFrame) -> DataFrame:
    """repo, symbol_id, gram: the trigrams of what ``symbol_search`` looks through, as catalogues hold them."""
    return trigrams.name_grams(symbols, ("repo", "symbol_id"), *(text.ascii_lower(F.col(c)) for c in SEARCHED))


def path_grams(files: DataFrame) -> DataFrame:
    """repo, path, gram: the trigrams of paths, for ``file_search``."""
    return trigrams.name_grams(files.select("repo", "path").distinct(), ("repo", "path"), F.lower("path"))


def symbol_search(symbols: DataFrame, queries: DataFrame, limit: int = 20, fuzzy: bool = True, grams: DataFrame | None = None) -> DataFrame:
    """The symbols' columns with query_id, stage, rank and position: exact and prefix matches first, then what contains the query.

    The second stage is cut to twice the limit before symbols of the first are left out, so there may be fewer than
    ``limit`` results though more match. It meets symbols by ``grams`` (``symbol_grams``), or without them by the trigrams
    that are asked for, in one scan; only queries with fewer than three characters before a wildcard meet every symbol.
    """
    limit = clamp(limit, 1, 500)
    folded = symbols.withColumns({f"_{c}": text.ascii_lower(F.col(c)) for c in SEARCHED})
    asked = known(text.with_patterns(queries.select("query_id", F.trim("query").alias("query")), "query"))
    name, qualified = F.col("_name"), F.col("_qualified_name")
    same = lambda c: c == F.col("_q")
    starts = lambda c: c.startswith(F.col("_plain")) & F.like(c, F.col("_starts"))
    holds = lambda c: c.contains(F.col("_plain")) & F.like(c, F.col("_holds"))
    kept = [*symbols.columns, "query_id", "stage", "rank"]
    first = near(folded, asked, queries).where(same(name) | same(qualified) | starts(name) | starts(qualified))
    first = first.withColumns({"stage": F.lit(0), "rank": F.when(same(name), 0).when(same(qualified), 1).when(starts(name), 2).otherwise(5)}).select(*kept)
    order = ["rank", "path", "line", "symbol_id"]
    first = ranked(first, order, limit)
    if not fuzzy:
        return first
    part = holds(name) | holds(qualified) | holds(F.col("_signature")) | holds(F.col("_doc"))
    long = F.length("_plain") >= trigrams.N
    own = sent(asked.where(long), queries)
    if grams is None:
        second = trigrams.holding(folded, own, "_plain", *(F.col(f"_{c}") for c in SEARCHED))
    else:
        second = folded.join(trigrams.holders(grams, own, "_plain"), ["repo", "symbol_id"])
    second = second.where(part).select(*folded.columns, *asked.columns).unionByName(folded.join(sent(asked.where(~long), queries), part))
    second = second.withColumns({"stage": F.lit(1), "rank": F.when(same(name), 0).when(same(qualified), 1).when(starts(name), 2).otherwise(3)}).select(*kept)
    both = first.unionByName(ranked(second, order, 2 * limit))
    seen = Window.partitionBy(*GROUP, "symbol_id").orderBy("stage")
    both = both.withColumn("_", F.row_number().over(seen)).where("_ = 1").drop("_", "position")
    return ranked(both, ["stage", *order], limit)


def symbol_prefixes(symbols: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """As the first stage of ``symbol_search`` for every variant of each query; earlier variants go first."""
    folded = symbols.withColumns({"_name": text.ascii_lower(F.col("name")), "_qualified_name": text.ascii_lower(F.col("qualified_name"))})
    starts = lambda c: F.col(c).startswith(F.col("_plain")) & F.like(F.col(c), F.col("_starts"))
    level = F.when(F.col("_name") == F.col("_q"), 0).when(F.col("_qualified_name") == F.col("_q"), 1).when(starts("_name"), 2).when(starts("_qualified_name"), 3)
    pairs = near(folded, known(text.with_patterns(variants(queries), "variant")), queries).withColumn("level", level).where("level IS NOT NULL")
    best = pairs.groupBy(*GROUP, *[c for c in symbols.columns if c != "repo"]).agg(F.min(F.col("ordinal") * 4 + F.col("level")).alias("rank"))
    return ranked(best, ["rank", "path", "line", "symbol_id"], clamp(limit, 1, 500))


def representative_symbols(symbols: DataFrame, limit: int = 20) -> DataFrame:
    """For each repository its public symbols, one for each name (the first by path, line and id), by kind, path and line."""
    kinds = {"component": 0, "hook": 1, "class": 2, "function": 3, "method": 4, "constant": 3, "type": 3}
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in kinds.items()])
    public = symbols.where("exported AND name <> ''").withColumn("rank", rank).where("rank IS NOT NULL")
    once = ranked(public, ["path", "line", "symbol_id"], 1, "_", ("repo", "name")).drop("_")
    return ranked(once, ["rank", "path", "line", "symbol_id"], clamp(limit, 1, 500), by=("repo",))


def provider_rows(symbols: DataFrame, provider: str = "catalog") -> DataFrame:
    """What a search answers of each symbol: its doc is the summary, and the provider is told; all else of the row stays."""
    return symbols.withColumnRenamed("doc", "summary").withColumn("provider", F.lit(provider)).drop("full_doc", "symbol_id", "exported")


def path_search(files: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """The files' columns with query_id, rank and position: 0 the path, 1 a name that ends it, 2 such a name with a suffix, 3 part of it.

    Unlike ``file_search`` the query stands for itself only, its wildcards are live, and shorter paths go first.
    """
    q = text.strip_leading_dots(F.trim("query"))
    name = paths.basename(F.regexp_replace(q, "/+$", ""))
    asked = sent(queries.select("query_id", q.alias("_q"), name.alias("_base")).where("_q <> ''"), queries)
    path = F.col("path")
    at = lambda c, before="%", after="": text.like(path, c, before=before, after=after)
    in_folder = F.concat(F.lit("/"), F.col("_base"))
    rank = F.when(text.ascii_lower(path) == text.ascii_lower(F.col("_q")), 0).when(at(in_folder), 1).when(at(F.concat(in_folder, F.lit(".")), after="%"), 2).when(at(F.col("_q"), after="%"), 3)
    rows = files.join(asked, F.lit(True)).withColumn("rank", rank).where("rank IS NOT NULL").drop("_q", "_base")
    return ranked(rows, ["rank", F.length("path"), "path"], clamp(limit, 1, 500))


def with_language(matches: DataFrame, files: DataFrame) -> DataFrame:
    """``matches`` (repo, path) with the language of their file."""
    return matches.join(files.select("repo", "path", "language"), ["repo", "path"])


def file_level(path: Column, variant: Column) -> Column:
    """0 the path, 1 its name or stem, 2 the end of it, 3 part of it; null if it doesn't match."""
    v = text.strip_leading_dots(F.lower(variant))
    p = F.lower(path)
    name = F.lower(paths.basename(path))
    stem = F.lower(paths.stem(paths.basename(path)))
    return F.when(p == v, 0).when((name == v) | (stem == v), 1).when(p.endswith(F.concat(F.lit("/"), paths.basename(v))), 2).when(p.contains(v), 3)


def file_search(files: DataFrame, queries: DataFrame, limit: int = 20, grams: DataFrame | None = None) -> DataFrame:
    """The files' columns with query_id, rank and position: by the first variant that matches, its level, length and path.

    Queries without anything but dots and slashes find nothing. Whatever matches a variant holds its last part, so files
    are met by that part's trigram in ``grams`` (``path_grams``), or without them by the trigrams that are asked for, in
    one scan; only variants whose last part has fewer than three characters meet every file.
    """
    each = variants(queries).where(text.strip_leading_dots(F.trim("variant")) != "")
    each = known(each.withColumn("_last", paths.basename(text.strip_leading_dots(F.lower("variant")))))
    long = F.length("_last") >= trigrams.N
    own = sent(each.where(long), queries)
    met = trigrams.holding(files, own, "_last", F.lower("path")) if grams is None else files.join(trigrams.holders(grams, own, "_last"), ["repo", "path"])
    pairs = met.select(*files.columns, *each.columns).unionByName(files.join(sent(each.where(~long), queries), F.length("_last") < trigrams.N))
    pairs = pairs.where(F.lower("path").contains(F.col("_last")))
    pairs = pairs.withColumn("level", file_level(F.col("path"), F.col("variant"))).where("level IS NOT NULL")
    best = pairs.groupBy(*GROUP, *[c for c in files.columns if c != "repo"]).agg(F.min(F.struct("ordinal", "level")).alias("best"))
    best = best.withColumn("rank", F.col("best.ordinal") * 4 + F.col("best.level")).drop("best")
    return ranked(best, ["rank", F.length("path"), "path"], clamp(limit, 1, 500))


#: Rows of top lists up to which they are broadcast to the text that they are read from.
MOST_TOP = 1_000_000


def text_search(lines: DataFrame, queries: DataFrame, limit: int = 20, budgets: DataFrame | None = None, grams: DataFrame | None = None, index: positions.Index | None = None) -> DataFrame:
    """query_id, query, repo, path, line, content, line_score, position: lines that contain the query.

    ``budgets`` (query_id, repo, budget) sets a limit of its own, at most ``limit``, for each query and repository. With
    ``grams`` (``trigrams.postings`` of the lines) only files that have all of a query's trigrams are read for it; with
    ``index`` (``positions.Index`` of the lines) only the lines of the top lists are.

    Queries of three characters and more are ranked twice: BM25 over the repository's lines, with the query as the one
    term and trigrams as length, keeps five times the limit; then the kind of line decides. How rare the query is counts
    for all its lines alike, so that factor is left out. Shorter queries go by path and line, and their wildcards are
    live. An empty query is an error.
    """
    limit = clamp(limit, 1, 500)
    wide = max(limit, min(5 * limit, 500))
    if index is not None:
        found = found_by_places(index, queries, wide, budgets)
    else:
        if not queries.where("trim(query) = ''").isEmpty():
            raise ValueError("empty query")
        found = found_by_scan(lines, queries, grams)
    kept = ranked(found, ["bm25", "path", "line"], wide)
    most = F.lit(limit)
    if budgets is not None:
        kept = kept.join(budgets, [*GROUP])
        most = F.least(F.col("budget"), F.lit(limit))
        kept = kept.where((most > 0) & (F.col("position") <= F.greatest(most, F.least(most * 5, F.lit(500)))))
    score = F.when(F.length("query") < 3, F.lit(0)).otherwise(text.text_line_score(F.col("content"), F.col("query"), paths.is_test(F.col("path"), "catalog")))
    kept = kept.drop("position").withColumn("line_score", score.cast("long"))
    return ranked(kept, ["line_score", "path", "line"], limit).where(F.col("position") <= most).select("query_id", "query", "repo", "path", "line", "content", "line_score", "position")


def line_rank(query: Column, tf: Column, length: Column, mean: Column) -> Column:
    """A matching line's BM25, the more negative the better; 0 for queries that are too short to be ranked."""
    return F.when(F.length(query) < 3, F.lit(0.0)).otherwise(-saturated(tf, F.greatest(length - 2, F.lit(0)), F.greatest(mean, F.lit(1e-9))))


def found_by_scan(lines: DataFrame, queries: DataFrame, grams: DataFrame | None) -> DataFrame:
    """query_id, query, repo, path, line, content and bm25 of every line that holds a query, by reading all lines or those of ``grams``' files."""
    short = F.length("query") < 3
    asked, folded = queries.withColumn("_q", F.lower("query")), lines.withColumn("_low", F.lower("content"))
    holds = F.col("_low").contains(F.col("_q"))
    if grams is None:
        found = folded.join(sent(asked, queries), F.when(short, text.like(F.col("content"), F.col("query"), before="%")).otherwise(holds))
    else:
        files = trigrams.candidates(grams, asked.where(~short)).join(asked, "query_id")
        found = folded.join(files, ["repo", "path"]).where(holds).unionByName(folded.join(sent(asked.where(short), queries), text.like(F.col("content"), F.col("query"), before="%")))
    found = found.drop("_low", "_q").join(positions.mean_lengths(lines), "repo").withColumn("tf", text.occurrences(F.col("content"), F.col("query")))
    return found.withColumn("bm25", line_rank(F.col("query"), F.col("tf"), F.length("content"), F.col("mean_length"))).drop("tf", "mean_length")


def found_by_places(index: positions.Index, queries: DataFrame, wide: int, budgets: DataFrame | None) -> DataFrame:
    """As ``found_by_scan`` for the first ``wide`` lines of each query and repository, which are ranked by postings alone.

    Short queries with wildcards or other characters than ASCII have no postings and read all lines.
    """
    known = queries.select("query_id", "query", positions.served(F.col("query")).alias("_served")).limit(MOST_QUERIES + 1).collect()
    if any(r["query"] is not None and not r["query"].strip(" ") for r in known):
        raise ValueError("empty query")
    few = len(known) <= MOST_QUERIES
    own = trigrams.local([r[:2] for r in known if r["_served"]], queries.select("query_id", "query")) if few else queries.where(positions.served(F.col("query")))
    where = None if budgets is None else budgets.where("budget > 0").select(*GROUP)
    short = not few or any(r["_served"] and len(r["query"]) < 3 for r in known)
    top = positions.places_of(index, own, short, repos=where)
    top = top.join(F.broadcast(own) if few else own, "query_id").join(index.means, "repo")
    top = ranked(top.withColumn("bm25", line_rank(F.col("query"), F.col("tf"), F.col("length"), F.col("mean_length"))), ["bm25", "segment", "at"], wide)
    top = top.select("query_id", "query", "bm25", "repo", "segment", "at", positions.shard_of(F.col("segment")).alias("shard"))
    top = F.broadcast(top) if few and len(known) * index.repos * wide <= MOST_TOP else top
    found = index.lines.join(top, ["repo", "shard", "segment", "at"]).drop("shard", "segment", "at")
    rest = [r[:2] for r in known if not r["_served"]]
    if few and not rest:
        return found
    others = trigrams.local(rest, own) if few else queries.where(~positions.served(F.col("query")))
    return found.unionByName(found_by_scan(index.lines.drop("shard", "segment", "at"), others, None))


def idf(rows: Column, with_it: Column) -> Column:
    value = F.ln((rows - with_it + 0.5) / (with_it + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(1e-6))


def saturated(tf: Column, length: Column, mean: Column) -> Column:
    """BM25's term weight with k1 = 1.2 and b = 0.75."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))


def with_context(matches: DataFrame, lines: DataFrame, around: int = 1) -> DataFrame:
    """``matches`` with start_line, end_line and snippet: the indexed lines at most ``around`` away, numbered.

    The lines are found by (repo, path) and a range within it, so a match meets only its own file's.
    """
    around = clamp(around, 0, 10)
    near = lines.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("line").alias("near"), F.col("content").alias("near_content"))
    at = meet(matches, near, F.greatest(F.lit(0), F.col("line") - around), F.col("line") + around, "near")
    keys = matches.columns
    grouped = at.groupBy(*keys).agg(F.min("near").alias("start_line"), F.max("near").alias("end_line"), F.array_sort(F.collect_list(F.struct("near", "near_content"))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: F.concat(x["near"].cast("string"), F.lit(": "), x["near_content"])), "\n")
    return grouped.withColumn("snippet", joined).drop("s")


def resolve_path(files: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, repo, resolved: the path that equals the query, else the only one that ends with it, else null."""
    q = F.trim(text.strip_leading_dots(F.trim("query")))
    pairs = files.select("repo", "path").join(sent(queries), F.lit(True))
    ends = text.like(F.col("path"), q, before="%", after="")
    found = pairs.groupBy(*GROUP).agg(
        F.max(F.when(F.col("path") == q, F.col("path"))).alias("same"), F.count_if(ends).alias("n"), F.max(F.when(ends, F.col("path"))).alias("only")
    )
    return found.select("query_id", "repo", F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("resolved"))
