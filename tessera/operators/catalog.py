"""Catalogue tables on disk: published by repository, updated by file, and read by a manifest.

A catalogue is a folder with a version folder for each publication and a table ``_current`` whose latest snapshot names,
for each repository, the version that holds it. Snapshots are numbered; a publisher claims the next number first, so that of
two at a time none is lost. Tables are partitioned by repository, so a publication writes the
repositories that it touches and leaves the others where they are. A version is complete and counted before the snapshot
that names it is written, so a failed write leaves the old one in place. Usage events are a table beside the versions and
survive all of them. All files are read and written by Spark, so that a catalogue may be in any store that it reaches.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bm25, freshness, trigrams

SCHEMA_VERSION = 2
SCHEMAS = {
    "files": "repo string, path string, language string, line_count long, size_bytes long, content_hash string, modified_ns long",
    "symbols": "repo string, symbol_id long, name string, qualified_name string, kind string, path string, line long, end_line long, signature string, doc string, full_doc string, exported boolean",
    "dependencies": "repo string, source_path string, target_path string, import_name string, kind string, resolved boolean, category string",
    "text_lines": "repo string, path string, line long, content string",
    "meta": "repo string, key string, value string",
}
#: Tables made from the others when a version is published: postings of trigrams and of function documents.
INDEXES = {
    "text_grams": "repo string, path string, gram string",
    "function_terms": "repo string, symbol_id long, path string, field string, term string, tf long",
}
#: By which column a table's rows belong to a file.
FILE_COLUMN = {"dependencies": "source_path"}
#: A snapshot's folder, and how often a publisher tries to get a number.
CLAIMED, MOST_CLAIMS = "snapshot={}", 600
MANIFEST = "published long, repo string, version string, schema_version int"
#: Versions that a snapshot may name before the next publication writes all repositories anew.
MOST_VERSIONS = 64


class ConflictError(RuntimeError):
    """Another publisher was first: what was to be published rests on an older state."""


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    def _snapshots(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.root}/_current")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], MANIFEST)
            raise

    def manifest(self, with_number: bool = False) -> DataFrame:
        """repo, version, schema_version that readers see; a version of a later schema than this code's is an error."""
        rows = self._snapshots()
        last = rows.agg(F.max("published").alias("at"), F.max("schema_version").alias("schema")).first()
        if (last["schema"] or 0) > SCHEMA_VERSION:
            raise ValueError(f"catalogue schema {last['schema']} is newer than {SCHEMA_VERSION}")
        rows = rows.where(F.col("published") == (last["at"] or 0))
        return rows if with_number else rows.where("repo IS NOT NULL").drop("published")

    def versions(self) -> list[str]:
        """The versions that the manifest names, at most ``MOST_VERSIONS`` and one."""
        return sorted(r[0] for r in self.manifest().select("version").distinct().collect())

    def read(self, table: str) -> DataFrame:
        """A table as the manifest has it, empty if there is none; columns that an older schema lacks are null."""
        schema = (SCHEMAS | INDEXES)[table]
        names = [c.split()[0] for c in schema.split(", ")]
        manifest = self.manifest()
        found = [self._table(v, table, schema).withColumn("version", F.lit(v)) for v in self.versions()]
        if not found:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, found).join(manifest.select("repo", "version"), ["repo", "version"], "left_semi").select(*names)
        return rows.withColumn("full_doc", F.coalesce("full_doc", F.lit(""))) if table == "symbols" else rows

    def _table(self, version: str, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{version}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):  # a version of no rows, or of an older schema
                return self.spark.createDataFrame([], schema)
            raise

    def publish(self, tables: dict[str, DataFrame], repos: DataFrame | None = None, expected: dict[str, int] | None = None, seen: dict[str, str] | None = None) -> str:
        """Write the tables of some repositories (``repos``; None: of all there are) as a new version and point to it.

        Every row is counted as it is written and again as it is read; ``expected`` gives counts that tables must have
        besides. What the version holds replaces all that was known of its repositories. Of two publishers of the same
        repository at a time the later one gets a ``ConflictError``; of different ones both succeed. ``seen`` is the state
        (repository: version) that the tables were made from; None: that of now.
        """
        version, seen = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", self._latest()[1] if seen is None else seen
        at = f"{self.root}/{version}"
        made = dict(tables)
        for name, schema in (SCHEMAS | INDEXES).items():
            if name in INDEXES and name not in made:
                made[name] = self._index(version, name)
            df = made.get(name)
            df = self.spark.createDataFrame([], schema) if df is None else df.select(*[c.split()[0] for c in schema.split(", ")])
            observed = _counted(df, f"{at}/{name}")
            written = self._table(version, name, schema).count()
            if written != observed or written != (expected or {}).get(name, written):
                raise RuntimeError(f"{name}: {written} rows written of {(expected or {}).get(name, observed)}")
        own = (repos.select("repo") if repos is not None else self._repos(version)).distinct()
        self._point(version, own, whole=repos is None, seen=seen)
        return version

    def _point(self, version: str, own: DataFrame, whole: bool, seen: dict[str, str]) -> None:
        """Write the snapshot in which ``version`` holds the repositories ``own``, after the latest one, whoever wrote that.

        Snapshots are numbered, and a number is claimed by creating a file that mustn't exist; whoever loses the claim reads
        what the winner wrote and tries the next. Repositories that another publisher has published since ``seen`` was read
        are a conflict if this version holds them too; all others stay as they are now.
        """
        names = {r[0] for r in own.collect()}  # one publication's repositories
        for _ in range(MOST_CLAIMS):
            number, now = self._latest()
            changed = {r for r in now if now[r] != seen.get(r)} | ({r for r in seen if r not in now} if not whole else set())
            if lost := sorted(changed if whole else changed & names):
                raise ConflictError(f"published by others meanwhile: {', '.join(lost[:5])}")
            if self._claim(number + 1):
                kept = {} if whole else {r: v for r, v in now.items() if r not in names}
                schemas = {r["repo"]: r["schema_version"] for r in self.manifest().collect()}
                rows = [(number + 1, r, version, SCHEMA_VERSION) for r in names] + [(number + 1, r, v, schemas[r]) for r, v in kept.items()]
                self.spark.createDataFrame(rows or [(number + 1, None, None, SCHEMA_VERSION)], MANIFEST).coalesce(1).write.parquet(f"{self.root}/_current/{CLAIMED.format(number + 1)}")
                return
            time.sleep(0.05)
        raise ConflictError(f"no snapshot could be claimed in {MOST_CLAIMS} tries")

    def _latest(self) -> tuple[int, dict[str, str]]:
        """The latest snapshot's number, and the version of each repository in it; a number that is claimed isn't written yet."""
        rows = self.manifest(with_number=True).collect()
        return max((r["published"] for r in rows), default=0), {r["repo"]: r["version"] for r in rows if r["repo"] is not None}

    def _claim(self, number: int) -> bool:
        """Whether this publisher may write the snapshot: only one can create the file."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{number}")
        try:
            at.getFileSystem(conf).create(at, False).close()
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _repos(self, version: str) -> DataFrame:
        return reduce(DataFrame.union, [self._table(version, t, s).select("repo") for t, s in SCHEMAS.items()])

    def _index(self, version: str, name: str) -> DataFrame:
        lines = self._table(version, "text_lines", SCHEMAS["text_lines"])
        if name == "text_grams":
            return trigrams.postings(lines)
        return bm25.postings(bm25.function_documents(self._table(version, "symbols", SCHEMAS["symbols"]), lines))

    def update(self, new: dict[str, DataFrame], touched: DataFrame, meta: DataFrame | None = None, also_files: DataFrame | None = None) -> str:
        """Publish the touched files' repositories (repo, path) with those files' rows replaced by ``new``; others stay where they are.

        Of ``also_files`` (repo, path) only the rows in ``files`` are replaced.
        """
        seen = self._latest()[1]
        repos = touched.select("repo")
        for more in (meta, also_files):
            repos = repos.union(more.select("repo")) if more is not None else repos
        repos = repos.distinct()
        if len(self.versions()) >= MOST_VERSIONS:
            repos = repos.union(self.manifest().select("repo")).distinct()
        tables = {}
        for name in ("files", "symbols", "dependencies", "text_lines"):
            column = FILE_COLUMN.get(name, "path")
            gone = touched.select("repo", "path") if also_files is None or name != "files" else touched.select("repo", "path").union(also_files.select("repo", "path"))
            tables[name] = _replaced(self.read(name).join(repos, "repo", "left_semi"), new.get(name), gone.withColumnRenamed("path", column), column)
        if "text_lines" in new:  # postings of untouched files stay
            grams = self.read("text_grams").join(repos, "repo", "left_semi")
            tables["text_grams"] = _replaced(grams, trigrams.postings(new["text_lines"]), touched, "path")
        old = self.read("meta").join(repos, "repo", "left_semi")
        tables["meta"] = freshness.upsert_meta(old, meta) if meta is not None else old
        return self.publish(tables, repos, seen=seen)

    def update_meta(self, meta: DataFrame) -> str:
        """Publish new meta values (repo, key, value) of some repositories."""
        return self.update({}, self.spark.createDataFrame([], "repo string, path string"), meta)

    def migrate(self) -> str | None:
        """Write a catalogue of an older schema anew in this one, whole, with its indexes made again; the old versions stay."""
        if not self.manifest().where(F.col("schema_version") < SCHEMA_VERSION).limit(1).count():
            return None
        symbols = self.read("symbols").withColumn("full_doc", F.when(F.col("full_doc") != "", F.col("full_doc")).otherwise(F.coalesce("doc", F.lit(""))))
        return self.publish({name: symbols if name == "symbols" else self.read(name) for name in SCHEMAS})

    def vacuum(self) -> list[str]:
        """Remove the versions that the manifest doesn't name, older snapshots, and claims of publishers that didn't end.

        No publisher may be at work, and no reader on an older snapshot.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs, kept, gone = at.getFileSystem(conf), set(self.versions()), []
        number = self._latest()[0]
        for folder, old in (("_current", lambda n: n.startswith("snapshot=") and int(n[9:]) < number), ("_claims", lambda n: n.isdigit() and int(n) != number)):
            here = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
            for status in fs.listStatus(here) if fs.exists(here) else ():
                if old(status.getPath().getName()):
                    fs.delete(status.getPath(), True)
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in kept and fs.delete(status.getPath(), True):
                gone.append(name)
        return gone

    def function_index(self) -> DataFrame:
        """The postings of the current function documents."""
        return self.read("function_terms")

    def record_usage(self, events: DataFrame) -> None:
        from tessera.operators import telemetry

        telemetry.record(events, f"{self.root}/usage_events")

    def record_usage_with_savings(self, tool: str, provider: str, query: str, results: DataFrame) -> None:
        """Append an event of a call whose results (repo, path) name files, with the tokens that not reading the others saves."""
        from tessera.operators import telemetry

        self.record_usage(telemetry.event_of(self.read("files"), results, tool, provider, query))


def _replaced(old: DataFrame, new: DataFrame | None, touched: DataFrame, column: str) -> DataFrame:
    kept = old.join(touched.select("repo", column).distinct(), ["repo", column], "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns)) if new is not None else kept


def _counted(df: DataFrame, path: str) -> int:
    """Write a table by repository and return how many rows went by, without reading its source twice."""
    from pyspark.sql import Observation

    seen = Observation(uuid.uuid4().hex)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("repo").parquet(path)
    return seen.get["n"]
