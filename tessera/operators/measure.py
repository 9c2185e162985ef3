"""Measured usage and benchmarks: normalised counts, paired reports, scorecards, overlaps, timings and deltas."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths

COUNTS = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens")
ARMS = ("baseline", "treatment")


def count_of(usage: Column, *names: str) -> Column:
    """The first of the named counts that is there; negative ones are errors."""
    value = F.coalesce(*[F.try_element_at(usage, F.lit(n)) for n in names]).cast("long")
    return F.when(value < 0, F.raise_error(F.lit("usage counts must be nonnegative integers or null")).cast("long")).otherwise(value)


def normalised(provider: Column, usage: Column) -> Column:
    """A struct of the four counts of ``usage`` (map of string to long) by its provider's meaning; unknown stays null.

    Counts of anthropic leave cache reads and writes out of the input, so all three are added; those of openai hold
    them. Nested counts are keyed as ``input_tokens_details.cached_tokens``.
    """
    own, a, o, n = (lambda *names: count_of(usage, *names)), provider == "anthropic", provider == "openai", provider == "normalized"
    base, read, write = own("input_tokens"), own("cache_read_input_tokens"), own("cache_creation_input_tokens")
    unknown = F.raise_error(F.lit("unsupported usage provider")).cast("long")
    total = F.when(a, base + read + write).when(o, own("input_tokens", "prompt_tokens")).when(n, base).otherwise(unknown)
    cached = F.when(a, read).when(o, own("input_tokens_details.cached_tokens", "prompt_tokens_details.cached_tokens")).otherwise(own("cached_input_tokens"))
    cached = F.when(cached > total, F.raise_error(F.lit("cached input exceeds total input")).cast("long")).otherwise(cached)
    out = F.when(o, own("output_tokens", "completion_tokens")).otherwise(own("output_tokens"))
    written = F.when(a, write).when(n, own("cache_write_tokens"))
    return F.struct(total.alias("input_tokens"), out.alias("output_tokens"), cached.alias("cached_input_tokens"), written.alias("cache_write_tokens"))


def known_sum(c: Column) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def task_measures(records: DataFrame) -> DataFrame:
    """pair_id, arm, controls, success, elapsed_ms, model_calls and the counts of each task, over its calls."""
    calls = records.select("pair_id", "arm", "model", "revision", "prompt_id", "config_id", "success", "elapsed_ms", F.explode("calls").alias("call"))
    each = calls.withColumn("u", normalised(F.col("call.provider"), F.col("call.usage"))).withColumn("n", F.col("call.model_calls"))
    keys = [c for c in records.columns if c != "calls"]
    return each.groupBy(*[k for k in keys if k in each.columns]).agg(*(known_sum(F.col(f"u.{c}")).alias(c) for c in COUNTS), known_sum(F.col("n")).alias("model_calls"))


def pairs(tasks: DataFrame, treatment: str = "treatment") -> DataFrame:
    """pair_id with the measures of both arms as <arm>_<measure>; pairs that lack an arm, repeat one or differ in a control are errors."""
    tasks = tasks.withColumn("arm", F.when(F.col("arm") == treatment, "treatment").otherwise(F.col("arm")))  # the other arm by its name in the records
    measures = (*COUNTS, "elapsed_ms", "model_calls", "success")
    pick = lambda arm, m: F.max(F.when(F.col("arm") == arm, F.col(m))).alias(f"{arm}_{m}")
    controls = F.struct("model", "revision", "prompt_id", "config_id")
    rows = tasks.withColumn("success", F.col("success").cast("long")).groupBy("pair_id").agg(
        *(pick(a, m) for a in ARMS for m in measures), F.count("*").alias("_n"), *(F.count_if(F.col("arm") == a).alias(f"_{a}") for a in ARMS), F.count_distinct(controls).alias("_same"),
        F.bool_and(F.forall(F.array("model", "revision", "prompt_id", "config_id"), lambda c: F.coalesce(c != "", F.lit(False)))).alias("_set"),
    )
    wrong = (F.col("_n") != 2) | (F.col("_baseline") != 1) | (F.col("_treatment") != 1)
    checked = F.when(wrong, F.raise_error(F.lit("incomplete or repeated task pair")).cast("string")).when((F.col("_same") != 1) | ~F.col("_set"), F.raise_error(F.lit("mismatched or missing experimental controls")).cast("string")).otherwise(F.col("pair_id"))
    return rows.where(checked.isNotNull()).drop("_n", "_same", "_set", "_baseline", "_treatment")


def reduction(before: Column, after: Column) -> Column:
    """By how many percent ``after`` is less; null where either is unknown or there was nothing before."""
    return F.when((before != 0) & after.isNotNull(), 100.0 * (before - after) / before)


#: Rank error of the quantile sketches that bracket a median, as one in so many of a group's values.
ACCURACY = 10_000


def with_medians(rows: DataFrame, measured: DataFrame, by: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``rows`` (one for each ``by``, null a key like any other) with the exact median of ``value`` over ``measured`` as ``name``.

    A sketch of fixed size brackets each group's median; what is below is only counted, and what is inside, of some
    n * 4 / ``ACCURACY`` values, is put in order, equal values as one. So no group's values meet in one task. Nulls don't
    count, NaN is the largest value, and a group without values has none. Of two middle values it is the mean.
    """
    values = measured.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    off = 2 / ACCURACY
    near = values.groupBy(*by).agg(F.percentile_approx("_v", [0.5 - off, 0.5 + off], ACCURACY).alias("_q"), F.count("*").alias("_n"))
    inside = joined_by(values, near, by).where(F.col("_v") <= F.col("_q")[1])
    counts = inside.groupBy(*by, "_n", F.when(F.col("_v") < F.col("_q")[0], F.lit(None)).otherwise(F.col("_v")).alias("_b")).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda k: F.max(F.when(F.expr(f"_upto >= {k} AND _upto - _c < {k}"), F.coalesce("_b", F.raise_error(F.lit("a median is outside of its bracket")).cast("double"))))
    middle = upto.groupBy(*by).agg((at("(_n + 1) div 2") * 0.5 + at("_n div 2 + 1") * 0.5).alias(name))
    return joined_by(rows, middle, by)


def joined_by(rows: DataFrame, other: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with the other columns of ``other``, which has at most one row for each ``by``; null keys meet each other."""
    own = other.withColumnsRenamed({k: f"_key_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by]
    return rows.join(own, same, "left").drop(*(f"_key_{k}" for k in by))


def paired_report(records: DataFrame, treatment: str = "treatment") -> DataFrame:
    """measure, baseline_total, baseline_tasks, treatment_total, treatment_tasks, median_reduction, reduction_pairs."""
    p = pairs(task_measures(records), treatment)
    names = (*COUNTS, "elapsed_ms", "model_calls", "success")
    each = p.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"baseline_{m}").cast("long").alias("b"), F.col(f"treatment_{m}").cast("long").alias("t")) for m in names])).alias("x")).select("x.*")
    less = F.when(F.col("measure").isin("input_tokens", "output_tokens", "elapsed_ms"), reduction(F.col("b"), F.col("t")))
    sums = each.groupBy("measure").agg(known_sum(F.col("b")).alias("baseline_total"), F.count("b").alias("baseline_tasks"), known_sum(F.col("t")).alias("treatment_total"), F.count("t").alias("treatment_tasks"), F.count(less).alias("reduction_pairs"))
    return with_medians(sums, each, ("measure",), less, "median_reduction")


def timing_stats(runs: DataFrame, by: tuple[str, ...] = ("provider", "query")) -> DataFrame:
    """avg, exact median, min and max of elapsed_ms, to three places."""
    r = lambda c, n: F.bround(c, 3).alias(n)
    rows = runs.groupBy(*by).agg(r(F.avg("elapsed_ms"), "avg_ms"), r(F.min("elapsed_ms"), "min_ms"), r(F.max("elapsed_ms"), "max_ms"))
    return with_medians(rows, runs, by, F.col("elapsed_ms"), "median_ms").withColumn("median_ms", F.bround("median_ms", 3))


def provider_overlap(results: DataFrame, baseline: str) -> DataFrame:
    """query, provider, shared, jaccard, baseline_only, provider_only of the paths (query, provider, path) against a provider's."""
    sets = results.groupBy("query", "provider").agg(F.collect_set("path").alias("paths"))
    base = sets.where(F.col("provider") == baseline).select("query", F.col("paths").alias("base"))
    both = sets.where(F.col("provider") != baseline).join(base, "query")
    union = F.size(F.array_union("paths", "base"))
    jaccard = F.when(union == 0, F.lit(1.0)).otherwise(F.bround(F.size(F.array_intersect("paths", "base")) / union, 3))
    only = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return both.select("query", "provider", F.size(F.array_intersect("paths", "base")).cast("long").alias("shared"), jaccard.alias("jaccard"), only("base", "paths").alias("baseline_only"), only("paths", "base").alias("provider_only"))


def quality_metrics(results: DataFrame) -> DataFrame:
    """provider, query, results, source_paths, test_paths, first_path, first_is_test of ranked results (…, path, position)."""
    test = paths.is_test(F.col("path"), "benchmark")
    return results.groupBy("provider", "query").agg(F.count("*").alias("results"), F.count_if(~test).alias("source_paths"), F.count_if(test).alias("test_paths"), F.min_by("path", "position").alias("first_path"), F.min_by(test, "position").alias("first_is_test"))


def scorecard(runs: DataFrame, baseline: str) -> DataFrame:
    """provider, queries, results, median_avg_ms, source_first, test_first and speedup over a provider's median."""
    rows = runs.groupBy("provider").agg(F.count("*").alias("queries"), F.sum("results").cast("long").alias("results"), F.count_if(~F.col("first_is_test")).alias("source_first"), F.count_if("first_is_test").alias("test_first"))
    rows = with_medians(rows, runs, ("provider",), F.col("avg_ms"), "median_avg_ms")
    base = rows.where(F.col("provider") == baseline).agg(F.max("median_avg_ms").alias("_base"))  # one row
    return rows.crossJoin(base).withColumn("speedup", F.when(F.col("median_avg_ms") > 0, F.bround(F.col("_base") / F.col("median_avg_ms"), 3))).drop("_base")


def symbol_scorecard(runs: DataFrame, baseline: str) -> DataFrame:
    """A row a provider over a suite's runs (provider, query_no, median_ms, results, source_paths, test_paths, first_path, first_is_test).

    first_paths are the first results' paths in the order of the queries, joined by commas; speedup is a provider's mean
    of medians over the baseline's, and the deltas tell how much more often the baseline puts source, or this a test, first.
    """
    has = F.coalesce(F.col("first_path"), F.lit("")) != ""
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has, F.struct("query_no", "first_path")))), lambda x: x["first_path"]), ",")  # a suite's queries
    rows = runs.groupBy("provider").agg(
        F.count("*").alias("queries"), F.bround(F.sum("median_ms") / F.count("*"), 3).alias("median_ms_avg"), *(F.sum(c).cast("long").alias(c) for c in ("results", "source_paths", "test_paths")),
        F.count_if(has & ~F.col("first_is_test")).alias("source_first"), F.count_if(has & F.col("first_is_test")).alias("test_first"), first.alias("first_paths"),
    )
    base = rows.where(F.col("provider") == baseline).agg(F.max("median_ms_avg").alias("_ms"), F.max("source_first").alias("_source"), F.max("test_first").alias("_test"))  # one row
    other = F.col("provider") != baseline
    return rows.crossJoin(base).withColumns({
        "speedup": F.when(other, F.when(F.col("_ms") > 0, F.bround(F.col("median_ms_avg") / F.col("_ms"), 3)).otherwise(F.lit(0.0))),
        "source_first_delta": F.when(other, F.col("_source") - F.col("source_first")), "test_first_delta": F.when(other, F.col("test_first") - F.col("_test")),
    }).drop("_ms", "_source", "_test")


WORKFLOW_SUMS = ("source_paths", "test_paths", "selected_files", "selected_lines", "estimated_tokens", "estimated_saved_tokens", "payload_bytes")


def workflow_scorecard(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each ``by``, over workflow runs (query_no, median_ms, first_path, first_is_test, ``WORKFLOW_SUMS``); of no runs zeros."""
    has = F.coalesce(F.col("first_path"), F.lit("")) != ""
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(has, F.struct("query_no", "first_path")))), lambda x: x["first_path"]), ",")  # a suite's queries
    return runs.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(has & ~F.col("first_is_test")).alias("source_first"), F.count_if(F.col("first_is_test")).alias("test_first"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_total") for c in WORKFLOW_SUMS), F.coalesce(F.bround(F.avg("median_ms"), 3), F.lit(0.0)).alias("median_ms_avg"), first.alias("first_paths"),
    )


def payload_bytes(*columns: str) -> Column:
    """The length in UTF-8 of a row's columns as JSON."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("long")


def record_run(scorecards: DataFrame, path: str, suite: str, measures: tuple[str, ...]) -> DataFrame:
    """Append a suite's scorecard (a row a provider) to its history and return it with the deltas against the run before."""
    spark = scorecards.sparkSession
    try:
        old = spark.read.json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    now = scorecards.withColumns({"suite_name": F.lit(suite), "recorded_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")})
    now = spark.createDataFrame(now.collect(), now.schema)  # a row a provider
    both = now if old is None else old.unionByName(now, allowMissingColumns=True).where(F.col("suite_name") == suite)
    out = deltas(both, measures, ("suite_name", "provider")).join(now.select("recorded_at").distinct(), "recorded_at", "left_semi")
    out = spark.createDataFrame(out.collect(), out.schema)
    now.coalesce(1).write.mode("append").json(path)
    return out


def deltas(history: DataFrame, measures: tuple[str, ...], by: tuple[str, ...] = ("suite_name",), order: str = "recorded_at") -> DataFrame:
    """``history`` with <measure>_delta against the run before; what is missing counts as 0, the first run has null."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.row_number().over(w) == 1
    return history.withColumns({f"{m}_delta": F.when(~first, F.bround((F.coalesce(m, F.lit(0)) - F.coalesce(F.lag(m).over(w), F.lit(0))).cast("double"), 3)) for m in measures})


def arm_order(n: int, iterations: int) -> list[list[str]]:
    """Which arm goes first for each task and iteration: they alternate."""
    return [[ARMS[(i + t) % 2] for t in range(n)] for i in range(iterations)]


def timed(run: Callable[[], DataFrame], repeat: int = 3, warmup: int = 1) -> list[float]:
    """Milliseconds of each of ``repeat`` runs of a plan, all rows computed and none kept."""
    out = []
    for i in range(warmup + repeat):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            out.append(1000 * (time.perf_counter() - began))
    return out


def benchmark(runs: dict[tuple[str, int, str], Callable[[], DataFrame]], spark, repeat: int = 3, warmup: int = 1) -> DataFrame:
    """provider, query_no, query, results, avg_ms, median_ms, min_ms, max_ms, first_path, first_is_test, source_paths, test_paths.

    ``runs`` has a plan for each provider and query, whose rows have path and position. Each plan is run ``warmup`` times
    and then timed ``repeat`` times; what it finds is taken once.
    """
    times, found = [], None
    for (provider, no, query), make in runs.items():
        times += [(provider, no, query, ms) for ms in timed(make, repeat, warmup)]
        rows = make().select(F.lit(provider).alias("provider"), F.lit(query).alias("query"), "path", "position")
        found = rows if found is None else found.unionByName(rows)
    stats = timing_stats(spark.createDataFrame(times, "provider string, query_no int, query string, elapsed_ms double"), ("provider", "query_no", "query"))
    return stats.join(quality_metrics(found), ["provider", "query"], "left").na.fill(0, ["results", "source_paths", "test_paths"]).na.fill(False, ["first_is_test"])


def run_suite(spark, name: str, queries: list[str], providers: dict[str, Callable[[str], DataFrame]], history: str | None = None, repeat: int = 3, warmup: int = 1) -> DataFrame:
    """The scorecard of a suite: every provider's plan for every query timed, the first provider the baseline.

    With ``history`` the scorecard is appended there and returned with the deltas against the suite's run before.
    """
    runs = {(p, i, q): (lambda make=make, q=q: make(q)) for p, make in providers.items() for i, q in enumerate(queries)}
    card = symbol_scorecard(benchmark(runs, spark, repeat, warmup), next(iter(providers)))
    return card if history is None else record_run(card, history, name, ("queries", "median_ms_avg", "results", "source_first", "test_first"))


def workflow_runs(times: DataFrame, hits: DataFrame, totals: DataFrame, payloads: DataFrame) -> DataFrame:
    """What ``workflow_scorecard`` reads, a row a query: times (query_id, elapsed_ms), hits (query_id, path, position), ``pack_totals`` and payload sizes."""
    found = quality_metrics(hits.withColumns({"provider": F.lit(""), "query": F.col("query_id")})).drop("provider", "results").withColumnRenamed("query", "query_id")
    rows = timing_stats(times, ("query_id",)).join(found, "query_id", "left").join(totals, "query_id", "left").join(payloads.select("query_id", F.col("bytes").alias("payload_bytes")), "query_id", "left")
    return rows.withColumnRenamed("query_id", "query_no").na.fill(0).na.fill(False, ["first_is_test"])


def hits_at(hits: DataFrame, cases: DataFrame, modes: DataFrame, k: int = 3) -> DataFrame:
    """mode, queries, hits: of the cases (query_id, expected) how many each mode finds among the first ``k`` hits (mode, query_id, position, label)."""
    last = F.substring_index(F.substring_index("label", " ", -1), ".", -1)
    first = hits.where(F.col("position") <= k).select("mode", "query_id", last.alias("expected")).distinct().withColumn("hit", F.lit(1))
    rows = modes.select("mode").distinct().crossJoin(cases.select("query_id", "expected")).join(first, ["mode", "query_id", "expected"], "left")  # a few modes
    return rows.groupBy("mode").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"))


def hit_at(hits: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """query_id, hit: whether the expected label is among the first ``k`` hits of each case (query_id, expected)."""
    first = hits.where(F.col("position") <= k).select("query_id", F.substring_index("label", " ", -1).alias("found"))
    return cases.join(first, "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or((F.col("found") == F.col("expected")) | F.col("found").endswith(F.concat(F.lit("."), F.col("expected")))), F.lit(False)).alias("hit"))
