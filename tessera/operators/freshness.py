"""What changed between a catalogue and the files that are there now, and whether the catalogue can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reasons for which a catalogue is stale, in the order in which they are told.
REASONS = (
    "git_head_changed",
    "catalog_analyzer_version_changed",
    "git_worktree_dirty",
    "source_files_added",
    "source_files_removed",
    "cataloged_files_changed",
    "catalog_schema_lacks_fingerprints",
    "catalog_schema_lacks_text_index",
)
SAMPLE = 20


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, path, status: added, removed, reused (same size and time), touched (same hash) or changed.

    Both sides have size_bytes, modified_ns and content_hash; an empty old hash never counts as the same.
    """
    o = old.select("repo", "path", *(F.col(c).alias(f"_o_{c}") for c in ("size_bytes", "modified_ns", "content_hash")), F.lit(True).alias("_old"))
    n = new.select("repo", "path", *(F.col(c).alias(f"_n_{c}") for c in ("size_bytes", "modified_ns", "content_hash")), F.lit(True).alias("_new"))
    stat = (F.col("_o_size_bytes") == F.col("_n_size_bytes")) & (F.col("_o_modified_ns") == F.col("_n_modified_ns"))
    same = (F.col("_o_content_hash") != "") & (F.col("_o_content_hash") == F.col("_n_content_hash"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(stat, "reused").when(same, "touched").otherwise("changed")
    return o.join(n, ["repo", "path"], "full").select("repo", "path", status.alias("status"))


def counts(changes: DataFrame) -> DataFrame:
    """repo, added, removed, changed, touched, reused."""
    return changes.groupBy("repo").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "touched", "reused")))


def reasons(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order."""
    each = F.array(*[F.when(flags[r], F.lit(r)) for r in REASONS if r in flags])
    return F.filter(each, lambda r: r.isNotNull())


def health(changes: DataFrame, meta: DataFrame, state: DataFrame) -> DataFrame:
    """repo, status, reasons, counts and the first paths of each kind of change.

    ``meta`` (repo, git_head, analyzer_version, fingerprints, text_index) is what the catalogue says of itself, ``state``
    (repo, git_head, analyzer_version, dirty) what holds now; a repository without a row in ``meta`` has no catalogue.
    """
    kinds = ("added", "removed", "changed")
    first = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("path"))))
    cut = Window.partitionBy("repo", "status").orderBy("path")
    sample = changes.where(F.col("status").isin(*kinds)).withColumn("_n", F.row_number().over(cut)).where(F.col("_n") <= SAMPLE)
    sums = changes.groupBy("repo").agg(*(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in kinds))
    sums = sums.join(sample.groupBy("repo").agg(*(first(s).alias(f"{s}_paths") for s in kinds)), "repo", "left")
    sums = sums.withColumns({f"{s}_paths": F.coalesce(f"{s}_paths", F.array().cast("array<string>")) for s in kinds})
    m = meta.select("repo", F.col("git_head").alias("was_head"), F.col("analyzer_version").alias("was_version"), "fingerprints", "text_index", F.lit(True).alias("known"))
    rows = state.join(m, "repo", "left").join(sums, "repo", "left").na.fill(0, ["added_count", "removed_count", "changed_count"])
    rows = rows.withColumn("changed_count", F.when(F.coalesce("fingerprints", F.lit(False)), F.col("changed_count")).otherwise(0))
    head, was = F.coalesce("git_head", F.lit("")), F.coalesce("was_head", F.lit(""))
    told = reasons({
        "git_head_changed": (head != "") & (was != "") & (head != was), "catalog_analyzer_version_changed": ~F.col("was_version").eqNullSafe(F.col("analyzer_version")), "git_worktree_dirty": F.col("dirty"),
        "source_files_added": F.col("added_count") > 0, "source_files_removed": F.col("removed_count") > 0, "cataloged_files_changed": F.col("changed_count") > 0,
        "catalog_schema_lacks_fingerprints": ~F.col("fingerprints"), "catalog_schema_lacks_text_index": ~F.col("text_index"),
    })
    rows = rows.withColumn("reasons", F.when(F.col("known"), told).otherwise(F.array(F.lit("catalog_missing"))))
    status = F.when(F.col("known").isNull(), "missing").when(F.size("reasons") > 0, "stale").otherwise("fresh")
    return rows.withColumn("status", status).drop("known", "was_head", "was_version", "git_head", "analyzer_version")


def upsert(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """``old`` without the rows of touched files (repo, path), and ``new``."""
    return old.join(touched.select("repo", "path").distinct(), ["repo", "path"], "left_anti").unionByName(new)


def upsert_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, key, value: new values replace old ones of the same key."""
    return old.join(new.select("repo", "key"), ["repo", "key"], "left_anti").unionByName(new)
