"""Scans: from folders to a published catalogue, whole or of what changed, for one repository or many in one job."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import freshness, graph
from tessera.operators.catalog import Catalog
from tessera.sources import discovery, extract, lines, resolve
from tessera.sources.shared import stored

#: Raised whenever extractors give other rows for the same file; catalogues of another version are made anew.
ANALYZER_VERSION = "2"
REPORT = ("repo", "ok", "error", "mode", "files", "written", "reused", "changed", "removed")


def analysed(sources: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The catalogue's tables of some files (repo, path, content, size_bytes, modified_ns), with imports resolved among ``paths``."""
    found = stored(extract.extract(sources), "extracted")
    return {
        "files": lines.file_rows(sources, discovery.LANGUAGES),
        "symbols": extract.symbols_of(found),
        "dependencies": resolve.resolve(extract.imports_of(found), paths.select("repo", "path"), paths.select("repo", "path")),
        "text_lines": lines.indexed_lines(sources),
    }


def metadata(state: DataFrame, counts: DataFrame, mode: str) -> DataFrame:
    """repo, key, value of a scan: when, by which version, from which commit, and how many files were reused or not."""
    now = time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())
    rows = state.join(counts, "repo", "left").na.fill(0)
    entries = {
        "generated_at": F.lit(now), "analyzer_version": F.lit(ANALYZER_VERSION), "git_head": F.col("git_head"), "git_status": F.col("git_status"), "repo_path": F.col("root"), "scan_mode": F.lit(mode),
        **{f"{k}_file_count": F.col(k).cast("string") for k in ("files", "reused", "changed", "removed")},
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return rows.select("repo", F.explode(pairs).alias("e")).select("repo", "e.key", "e.value")


def meta_of(store: Catalog) -> DataFrame:
    """repo and the meta values that decide whether a repository is scanned at all."""
    m = store.read("meta")
    return m.groupBy("repo").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"_{k}") for k in ("analyzer_version", "git_head", "git_status")))


def full(store: Catalog, repos: DataFrame, listed: DataFrame, state: DataFrame) -> None:
    """Publish the repositories anew: every listed file is read; a row must be written for each."""
    files = listed.select("repo", "root", "path", "size_bytes", "modified_ns")
    sources = stored(discovery.contents(files).where("content IS NOT NULL").select("repo", "path", "content", "size_bytes", "modified_ns"), "sources")
    tables = analysed(sources, listed)
    counts = sources.groupBy("repo").agg(F.count("*").alias("files"), F.lit(0).alias("reused"), F.count("*").alias("changed"), F.lit(0).alias("removed"))
    tables["meta"] = metadata(state, counts, "full")
    store.publish(tables, repos, {"files": sources.count()})


def incremental(store: Catalog, listed: DataFrame, state: DataFrame) -> DataFrame:
    """Publish what changed since the last scan; repo, reused, changed, removed, written of each repository.

    Files of the same size and time are reused unread; of the others the contents decide, and a file that only has another
    time keeps its rows. Files whose imports may lead elsewhere now, since files came or went, are analysed again.
    """
    old = stored(store.read("files").join(state.select("repo"), "repo", "left_semi"), "old")
    o = old.select("repo", "path", F.col("size_bytes").alias("_s"), F.col("modified_ns").alias("_t"))
    joined = listed.join(o, ["repo", "path"], "left")
    maybe = joined.where(F.col("_s").isNull() | (F.col("_s") != F.col("size_bytes")) | (F.col("_t") != F.col("modified_ns"))).select("repo", "root", "path", "size_bytes", "modified_ns")
    read = stored(discovery.contents(maybe).where("content IS NOT NULL").select("repo", "path", "content", "size_bytes", "modified_ns"), "read")
    # Of files that weren't read the old hash holds.
    hashes = read.select("repo", "path", F.sha2("content", 256).alias("_now"))
    known = old.select("repo", "path", F.col("content_hash").alias("_then"))
    new = listed.select("repo", "path", "size_bytes", "modified_ns").join(hashes, ["repo", "path"], "left").join(known, ["repo", "path"], "left").withColumn("content_hash", F.coalesce("_now", "_then", F.lit("")))
    changes = stored(freshness.diff(old, new), "changes")
    status = lambda *s: changes.where(F.col("status").isin(*s)).select("repo", "path")
    again = graph.to_reanalyse(store.read("dependencies"), status("removed"), status("added"), listed.select("repo", "path"))
    fresh = stored(status("added", "changed").union(again.select("repo", "path")).distinct(), "fresh")
    unread = fresh.join(read.select("repo", "path"), ["repo", "path"], "left_anti")
    more = discovery.contents(listed.join(unread, ["repo", "path"], "left_semi").select("repo", "root", "path", "size_bytes", "modified_ns")).where("content IS NOT NULL")
    sources = stored(read.join(fresh, ["repo", "path"], "left_semi").unionByName(more.drop("root")), "sources")
    counts = changes.groupBy("repo").agg(F.count_if(F.col("status") != "removed").alias("files"), F.count_if(F.col("status") == "removed").alias("removed"))
    written = fresh.groupBy("repo").agg(F.count("*").alias("changed"))
    counts = stored(state.select("repo").join(counts, "repo", "left").join(written, "repo", "left").na.fill(0).withColumn("reused", F.col("files") - F.col("changed")), "counts")
    touched_only = status("touched").join(fresh, ["repo", "path"], "left_anti")
    moved = changes.where("status IN ('touched', 'removed')").select("repo", "path").union(fresh)
    meta = metadata(state, counts, "incremental")
    if moved.isEmpty():
        store.update_meta(meta)
    else:
        tables = analysed(sources, listed)
        times = listed.select("repo", "path", F.col("size_bytes").alias("_s"), F.col("modified_ns").alias("_t"))
        kept = old.join(touched_only, ["repo", "path"], "left_semi").join(times, ["repo", "path"]).withColumns({"size_bytes": F.col("_s"), "modified_ns": F.col("_t")}).drop("_s", "_t")
        only_files = touched_only.select("repo", "path")
        store.update({**tables, "files": tables["files"].unionByName(kept)}, fresh.union(status("removed")).distinct(), meta, also_files=only_files)
    return counts.select("repo", "files", "reused", "changed", "removed", F.col("changed").alias("written"))


def scan(store: Catalog, repos: DataFrame, only_changes: bool = False) -> DataFrame:
    """repo, ok, error, mode, files, written, reused, changed, removed for each repository (repo, root) scanned.

    A repository that can't be listed is a row with its error, and its catalogue stays as it is. With ``only_changes`` a
    repository whose commit and worktree are those of the last scan isn't even listed (mode ``unchanged``), and one that
    has no catalogue, or that of another analyzer version, is scanned whole.
    """
    repos = stored(repos.select("repo", "root").distinct(), "repos")
    state = stored(repos.join(discovery.git_state(repos), "repo"), "state")
    known = stored(state.join(meta_of(store), "repo", "left"), "known")
    current = F.coalesce(F.col("_analyzer_version") == ANALYZER_VERSION, F.lit(False)) & F.lit(only_changes)
    same = current & (F.col("git_head") != "") & (F.col("git_head") == F.col("_git_head")) & (F.col("git_status") != "") & (F.col("git_status") == F.col("_git_status"))
    known = stored(known.withColumn("mode", F.when(same, "unchanged").when(current, "incremental").otherwise("full")).select("repo", "root", "git_head", "git_status", "mode"), "modes")
    listed = stored(discovery.listing(known.where("mode <> 'unchanged'").select("repo", "root")), "listed")
    errors = listed.where("error IS NOT NULL").select("repo", "error")
    todo = known.join(errors.select("repo"), "repo", "left_anti")
    parts = []
    for mode in ("full", "incremental"):
        part = stored(todo.where(F.col("mode") == mode), mode)
        if part.isEmpty():
            continue
        files = listed.where("error IS NULL").join(part.select("repo"), "repo", "left_semi").drop("error")
        if mode == "full":
            full(store, part.select("repo"), files, part.drop("mode"))
            n = files.groupBy("repo").agg(F.count("*").alias("files"))
            parts.append(part.select("repo").join(n, "repo", "left").na.fill(0).select("repo", "files", F.lit(0).alias("reused"), F.col("files").alias("changed"), F.lit(0).alias("removed"), F.col("files").alias("written")))
        else:
            parts.append(incremental(store, files, part.drop("mode")))
    done = None
    for p in parts:
        p = p.select("repo", *(F.col(c).cast("long") for c in ("files", "reused", "changed", "removed", "written")))
        done = p if done is None else done.unionByName(p)
    kept = store.read("files").join(known.where("mode = 'unchanged'").select("repo"), "repo", "left_semi").groupBy("repo").agg(F.count("*").alias("files"))
    kept = kept.select("repo", "files", F.col("files").alias("reused"), *(F.lit(0).cast("long").alias(c) for c in ("changed", "removed", "written")))
    done = kept if done is None else done.unionByName(kept)
    return known.select("repo", "mode").join(done, "repo", "left").join(errors, "repo", "left").withColumn("ok", F.col("error").isNull()).select(*REPORT)
