"""Discovery, catalogue versions, freshness, measures, event readers and streams."""

import json
import os
import random
import statistics
import subprocess

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import bm25, freshness, measure, rollups, scan, telemetry, trigrams
from tessera.operators.catalog import Catalog, ConflictError
from tessera.sources import discovery, events, lines
from tessera.streaming import usage
from tests.repos import SERVICE, catalog


def put(folder, tree):
    for p, c in tree.items():
        (folder / p).parent.mkdir(parents=True, exist_ok=True)
        (folder / p).write_text(c)


def test_walk_and_git(spark, tmp_path):
    put(tmp_path, {"src/app.py": "x = 1\n", "src/__init__.py": "", "src/_priv.py": "y = 2\n", "_gen/.hid.py": "", ".ssh/id_rsa.py": "k", ".env.py": "k", "node_modules/a.js": "1", "gen/b.py": "1", "note.txt": "t", "c.gen.py": "1", ".gitignore": "gen/\n*.gen.py\n# no\n"})
    found = ["_gen/.hid.py", "src/__init__.py", "src/_priv.py", "src/app.py"]
    rows = {r["path"]: r for r in discovery.walk(spark, "r", str(tmp_path)).collect()}
    assert sorted(rows) == found and (rows["src/app.py"]["content"], rows["src/app.py"]["size_bytes"]) == ("x = 1\n", 6)
    assert rows["src/app.py"]["modified_ns"] == (tmp_path / "src/app.py").stat().st_mtime_ns
    assert sorted(r["path"] for r in discovery.walk(spark, "r", f"file://{tmp_path}").collect()) == found
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    assert sorted(r["path"] for r in discovery.discover(spark, "r", str(tmp_path)).collect()) == found


def test_repositories_that_cannot_be_listed_are_rows(spark, tmp_path):
    put(tmp_path, {"a/x.py": "x = 1\n"})
    repos = discovery.repositories(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "none")})
    rows = {r["repo"]: r for r in discovery.listing(repos).collect()}
    assert rows["a"]["path"] == "x.py" and rows["a"]["error"] is None
    assert rows["b"]["path"] is None and "none" in rows["b"]["error"]
    assert [(r["repo"], r["content"]) for r in discovery.sources(repos).collect()] == [("a", "x = 1\n")]


def tables(c):
    return {"files": c.files, "symbols": c.symbols, "dependencies": c.dependencies, "text_lines": c.lines}


def rows(df):
    return sorted(map(str, df.collect()))


def test_publish_update_and_failure(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "c"))
    assert store.versions() == [] and store.read("files").count() == 0
    first = catalog(spark, SERVICE)
    store.publish(tables(first))
    store.record_usage(spark.createDataFrame([(1, "lookup")], "event_id long, tool string"))
    changed = {k: v for k, v in SERVICE.items() if k != "src/app/api.py"} | {"src/app/service.py": "class Service:\n    pass\n", "new.py": "def fresh(): pass\n"}
    second = catalog(spark, changed)
    diff = freshness.diff(store.read("files"), second.files)
    assert {r["path"]: r["status"] for r in diff.collect()} == {"src/app/__init__.py": "reused", "src/app/service.py": "changed", "src/app/api.py": "removed", "tests/test_service.py": "reused", "new.py": "added"}
    touched = diff.where("status <> 'reused'").select("repo", "path")
    part = {k: v.join(touched.withColumnRenamed("path", "source_path") if k == "dependencies" else touched, ["repo", "source_path" if k == "dependencies" else "path"], "left_semi") for k, v in tables(second).items()}
    store.update(part, touched)
    for name, df in tables(second).items():
        assert rows(store.read(name).select(*sorted(df.columns))) == rows(df.select(*sorted(df.columns))), name
    versions = store.versions()
    with pytest.raises(PySparkException):
        store.publish({"files": first.files.withColumn("size_bytes", F.raise_error(F.lit("no")).cast("long"))})
    assert store.versions() == versions and spark.read.parquet(str(tmp_path / "c/usage_events")).count() == 1
    assert store.function_index().count() > 0


def test_versions_by_repository(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "c"))
    store.publish(tables(catalog(spark, {"a": SERVICE, "b": {"x.py": "def f(): pass\n"}, "o'dd/r": {"y.py": "Y = 1\n"}})))
    new = catalog(spark, {"x.py": "def g(): pass\n", "z.py": "Z = 2\n"}, "b")
    touched = spark.createDataFrame([("b", "x.py"), ("b", "z.py")], "repo string, path string")
    version = store.update(tables(new), touched)
    assert {r["repo"] for r in spark.read.parquet(str(tmp_path / "c" / version / "files")).collect()} == {"b"}
    assert sorted((r["repo"], r["path"]) for r in store.read("files").where("repo <> 'a'").collect()) == [("b", "x.py"), ("b", "z.py"), ("o'dd/r", "y.py")]
    assert sorted(r["name"] for r in store.read("symbols").where("repo = 'b'").collect()) == ["Z", "g"]
    grams = {r["gram"] for r in store.read("text_grams").where("repo = 'b'").collect()}
    assert "g()" in grams and "f()" not in grams
    assert rows(store.read("text_grams")) == rows(trigrams.postings(store.read("text_lines")))
    assert rows(store.function_index()) == rows(bm25.postings(bm25.function_documents(store.read("symbols"), store.read("text_lines"))))
    store.update(tables(new), spark.createDataFrame([("a", p) for p in SERVICE], "repo string, path string"))
    store.publish({k: store.read(k) for k in ("files", "symbols", "dependencies", "text_lines", "meta")})
    assert len(store.versions()) == 1 and len(store.vacuum()) >= 2 and store.read("files").where("repo = 'b'").count() >= 2


def test_two_publishers_at_a_time(spark, tmp_path, monkeypatch):
    """A publication that another overtakes keeps the other's repositories, and is refused where both hold the same."""
    root = str(tmp_path / "c")
    one, two = Catalog(spark, root), Catalog(spark, root)
    one.publish(tables(catalog(spark, {"a": SERVICE, "b": {"x.py": "X = 1\n"}})))
    new = lambda repo, text: tables(catalog(spark, {"x.py": text}, repo))
    repos = lambda repo: spark.createDataFrame([(repo,)], "repo string")
    index = Catalog._index

    def overtaken(by):
        def run(self, version, name):
            if self is one and name == "function_terms":
                monkeypatch.setattr(Catalog, "_index", index)
                by()
            return index(self, version, name)

        monkeypatch.setattr(Catalog, "_index", run)

    overtaken(lambda: two.publish(new("c", "C = 1\n"), repos("c")))
    one.publish(new("b", "B = 2\n"), repos("b"))
    assert {r["repo"] for r in one.read("files").collect()} == {"a", "b", "c"}
    assert {r["name"] for r in one.read("symbols").where("repo <> 'a'").collect()} == {"B", "C"}
    overtaken(lambda: two.publish(new("b", "B = 3\n"), repos("b")))
    with pytest.raises(ConflictError, match="b"):
        one.publish(new("b", "B = 4\n"), repos("b"))
    assert {r["name"] for r in one.read("symbols").where("repo = 'b'").collect()} == {"B"} and one.read("text_lines").where("content = 'B = 3'").count() == 1
    overtaken(lambda: two.publish(new("d", "D = 1\n"), repos("d")))
    with pytest.raises(ConflictError):
        one.publish(tables(catalog(spark, {"a": SERVICE})))
    claimed = one._latest()[0] + 1
    assert one._claim(claimed) and not two._claim(claimed)
    one.vacuum()
    assert len([p for p in (tmp_path / "c/_current").iterdir() if p.is_dir()]) == 1 and {r["repo"] for r in two.read("files").collect()} == {"a", "b", "c", "d"}


def test_migration(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "c"))
    c = catalog(spark, SERVICE)
    c.symbols.drop("full_doc").withColumn("doc", F.lit("says")).write.partitionBy("repo").parquet(str(tmp_path / "c/v-old/symbols"))
    c.files.write.partitionBy("repo").parquet(str(tmp_path / "c/v-old/files"))
    spark.createDataFrame([(1, "r", "v-old", 1)], "published long, repo string, version string, schema_version int").write.parquet(str(tmp_path / "c/_current"))
    assert {r["full_doc"] for r in store.read("symbols").collect()} == {""}
    assert store.migrate() and store.migrate() is None
    assert {r["full_doc"] for r in store.read("symbols").collect()} == {"says"} and store.function_index().count() > 0
    spark.createDataFrame([(2, "r", "v-new", 9)], "published long, repo string, version string, schema_version int").write.mode("append").parquet(str(tmp_path / "c/_current"))
    with pytest.raises(ValueError, match="newer"):
        store.read("files")


def one(report, repo):
    return {r["repo"]: (r["ok"], r["mode"], r["files"], r["written"], r["reused"], r["changed"], r["removed"]) for r in report.collect()}[repo]


def test_scan_and_scan_of_changes(spark, tmp_path):
    put(tmp_path / "a", SERVICE)
    put(tmp_path / "b", {"x.py": "def f(): pass\n"})
    store = Catalog(spark, str(tmp_path / "c"))
    repos = discovery.repositories(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "gone": str(tmp_path / "no")})
    report = scan.scan(store, repos, only_changes=True)
    assert one(report, "a") == (True, "full", 4, 4, 0, 4, 0) and one(report, "b")[:3] == (True, "full", 1)
    assert not one(report, "gone")[0] and "no" in report.where("repo = 'gone'").first()["error"]
    edges = {(r["source_path"], r["target_path"]) for r in store.read("dependencies").where("resolved").collect()}
    assert edges == {("src/app/api.py", "src/app/service.py"), ("tests/test_service.py", "src/app/service.py")}
    assert one(scan.scan(store, repos, only_changes=True), "a") == (True, "incremental", 4, 0, 4, 0, 0)
    # One file is touched, one changes, one goes, one comes; those that import what went are read again.
    service = tmp_path / "a/src/app/service.py"
    os.utime(tmp_path / "a/src/app/__init__.py", ns=(5, 5))
    (tmp_path / "a/tests/test_service.py").write_text("def test_other():\n    pass\n")
    service.unlink()
    put(tmp_path / "a", {"src/app/more.py": "MORE = 1\n"})
    report = scan.scan(store, repos, only_changes=True)
    assert one(report, "a") == (True, "incremental", 4, 3, 1, 3, 1) and one(report, "b") == (True, "incremental", 1, 0, 1, 0, 0)
    assert sorted(r["path"] for r in store.read("files").where("repo = 'a'").collect()) == ["src/app/__init__.py", "src/app/api.py", "src/app/more.py", "tests/test_service.py"]
    assert store.read("files").where("path = 'src/app/__init__.py'").first()["modified_ns"] == 5
    assert {r["name"] for r in store.read("symbols").where("repo = 'a'").collect()} == {"call", "MORE", "test_other"}
    assert store.read("dependencies").where("repo = 'a' AND resolved").count() == 0
    other = Catalog(spark, str(tmp_path / "d"))
    scan.scan(other, repos)
    for name in ("files", "symbols", "dependencies", "text_lines", "text_grams", "function_terms"):
        assert rows(store.read(name)) == rows(other.read(name)), name


def test_unchanged_worktree_is_not_listed(spark, tmp_path):
    put(tmp_path / "a", SERVICE)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", *a], cwd=tmp_path / "a", check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "first")
    store = Catalog(spark, str(tmp_path / "c"))
    repos = discovery.repositories(spark, {"a": str(tmp_path / "a")})
    assert one(scan.scan(store, repos), "a")[1] == "full"
    assert one(scan.scan(store, repos, only_changes=True), "a") == (True, "unchanged", 4, 0, 4, 0, 0)
    (tmp_path / "a/src/app/api.py").write_text("def other(): pass\n")
    assert one(scan.scan(store, repos, only_changes=True), "a") == (True, "incremental", 4, 1, 3, 1, 0)
    assert one(scan.scan(store, repos, only_changes=True), "a")[1] == "unchanged"
    meta = {r["key"]: r["value"] for r in store.read("meta").collect()}
    assert meta["scan_mode"] == "incremental" and meta["reused_file_count"] == "3" and len(meta["git_head"]) == 40
    store.update_meta(spark.createDataFrame([("a", "analyzer_version", "0")], "repo string, key string, value string"))
    assert one(scan.scan(store, repos, only_changes=True), "a")[1] == "full"


def test_usage_with_savings(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "c"))
    store.publish(tables(catalog(spark, {"a.py": "x = 1\n" * 100, "b.py": "y = 1\n" * 10})))
    store.record_usage_with_savings("lookup", "catalog", "x", spark.createDataFrame([("r", "b.py"), ("r", "b.py")], "repo string, path string"))
    got = spark.read.parquet(str(tmp_path / "c/usage_events")).first()
    assert (got["candidate_files"], got["returned_files"], got["result_count"], got["estimated_saved_tokens"]) == (2, 1, 2, 880 - 80 - 80)


def test_lines_and_slices(spark):
    s = spark.createDataFrame([("r", "a.py", "one\r\n\n  \ntwo three\n", None, None), ("r", "b.py", None, None, None)], "repo string, path string, content string, size_bytes long, modified_ns long")
    assert [(r["line"], r["content"]) for r in lines.indexed_lines(s).orderBy("line").collect()] == [(1, "one"), (4, "two"), (5, "three")]
    assert lines.content_slice(s, "a.py", 1, 2).first()["content"] == "one\n"
    with pytest.raises(ValueError):
        lines.content_slice(s, "a.py", 3, 2)


def test_roll_ups(spark):
    c = catalog(spark, {"back": {"a/x.py": "def f(): pass\n", "a/b/y.py": "X = 1\n"}, "ui": {"src/App.jsx": "export function App() {}\n"}})
    got = {(r["repo"], r["directory"]): (r["files"], r["symbols"], r["languages"]) for r in rollups.directories(c.files, c.symbols, 2).collect()}
    assert got == {("back", "a"): (2, 2, "python"), ("back", "a/b"): (1, 1, "python"), ("ui", "src"): (1, 1, "jsx")}
    assert [(r["path"], r["type"]) for r in rollups.tree(c.files, c.symbols, 1, "a").where("repo = 'back'").orderBy("position").collect()] == [("a/b", "directory"), ("a/x.py", "file")]
    assert rollups.tree(c.files, c.symbols, 2, entries=1).where("repo = 'back'").first()["truncated"]
    files = spark.createDataFrame([("r", "a", 0), ("r", "b", 10), ("r", "c", 20)], "repo string, path string, line_count long")
    picked = spark.createDataFrame([("r", "b"), ("r", "b")], "repo string, path string")
    assert rollups.saved_by_paths(files, picked).first()["saved"] == 88
    assert {r["language"]: r["repos"] for r in rollups.workspace_outline(c.files, c.symbols).collect()} == {"python": 1, "jsx": 1}


def task(pair, arm, usage, provider="openai", elapsed=10, **more):
    return json.dumps({"pair_id": pair, "arm": arm, "model": "m", "revision": "r", "prompt_id": "p", "config_id": "c", "success": True, "elapsed_ms": elapsed, "calls": [{"provider": provider, "usage": usage}]} | more)


def report(spark, *records):
    df = events.task_records(spark.createDataFrame([(r,) for r in records], "value string"))
    return {r["measure"]: r.asDict() for r in measure.paired_report(df).collect()}


def test_paired_report(spark):
    got = report(spark, task("1", "baseline", {"input_tokens": 100, "output_tokens": 4, "input_tokens_details": {"cached_tokens": 60}}), task("1", "treatment", {"input_tokens": 50, "output_tokens": 4}))
    assert got["input_tokens"]["median_reduction"] == 50 and got["output_tokens"]["median_reduction"] == 0 and got["cached_input_tokens"]["baseline_total"] == 60
    got = report(spark, task("1", "baseline", {"input_tokens": 100}), task("1", "treatment", {}))
    assert got["input_tokens"]["treatment_total"] is None and got["input_tokens"]["treatment_tasks"] == 0 and got["input_tokens"]["reduction_pairs"] == 0
    anthropic = {"input_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2, "output_tokens": 1}
    got = report(spark, task("1", "baseline", anthropic, "anthropic"), task("1", "treatment", {"input_tokens": 5}, "anthropic"))
    assert got["input_tokens"]["baseline_total"] == 10 and got["input_tokens"]["treatment_total"] is None


@pytest.mark.parametrize("usage", [{"input_tokens": -1}, {"input_tokens": True}, {"input_tokens": 1.5}, {"input_tokens": "x"}, {"input_tokens": 1, "input_tokens_details": {"cached_tokens": 2}}])
def test_wrong_counts_are_errors(spark, usage):
    with pytest.raises(PySparkException):
        report(spark, task("1", "baseline", usage), task("1", "treatment", {}))


def test_wrong_pairs_are_errors(spark):
    base = task("1", "baseline", {})
    for other in (task("1", "baseline", {}), task("1", "treatment", {}, model="n"), task("2", "treatment", {})):
        with pytest.raises(PySparkException):
            report(spark, base, other)


def run(spark, agent, *lines_):
    df = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(lines_)], "run_id long, event_no long, value string")
    return events.agent_usage(df, agent).first()


def test_agent_streams(spark):
    got = run(spark, "codex", {"type": "item.completed", "item": {"type": "agent_message", "text": "first"}}, {"type": "item.completed", "item": {"type": "agent_message", "text": "last"}}, {"type": "turn.completed", "usage": {"input_tokens": 5, "output_tokens": 2, "cached_input_tokens": 1}})
    assert got["completed"] and got["answer"] == "last" and got["calls"][0]["input_tokens"] == 5 and got["error"] is None
    assert run(spark, "codex", {"type": "item.completed"})["error"]
    step = {"type": "step_finish", "part": {"id": "a", "reason": "stop", "tokens": {"input": 1, "output": 2, "cache": {"read": 3, "write": 4}}}}
    got = run(spark, "opencode", {"type": "step_start"}, {"type": "text", "part": {"text": "hi"}}, step)
    assert got["completed"] and got["calls"][0]["input_tokens"] == 8 and got["answer"] == "hi"
    assert run(spark, "opencode", step, step)["error"]
    got = run(spark, "claude", {"type": "assistant"}, {"type": "result", "subtype": "success", "is_error": False, "result": "ok", "usage": {"input_tokens": 1, "output_tokens": 1, "cache_read_input_tokens": 0, "cache_creation_input_tokens": 0}})
    assert got["completed"] and got["answer"] == "ok" and got["calls"][0]["input_tokens"] == 1
    got = run(spark, "hermes", {"input_tokens": 1, "output_tokens": 2, "cache_read_tokens": 0, "cache_write_tokens": 0, "api_calls": 3, "completed": True, "failed": False})
    assert got["completed"] and got["calls"][0]["model_calls"] == 3
    with pytest.raises(ValueError):
        run(spark, "paseo", {})


def test_overlap_and_deltas(spark):
    r = spark.createDataFrame([("q", "x", "a"), ("q", "x", "b"), ("q", "y", "b"), ("q", "y", "c")], "query string, provider string, path string")
    got = measure.provider_overlap(r, "x").first()
    assert (got["shared"], got["jaccard"], got["baseline_only"], got["provider_only"]) == (1, 0.333, "a", "c")
    h = spark.createDataFrame([("s", 1, 5, None), ("s", 2, 7, 3.5)], "suite_name string, recorded_at int, n long, m double")
    assert [(r["n_delta"], r["m_delta"]) for r in measure.deltas(h, ("n", "m")).orderBy("recorded_at").collect()] == [(None, None), (2.0, 3.5)]
    assert measure.arm_order(3, 2) == [["baseline", "treatment", "baseline"], ["treatment", "baseline", "treatment"]]


def test_foreign_index(spark):
    s = spark.createDataFrame([("a.py", "Load", "Load", "function", "", "", "", 1), ("b.py", "reload", "reload", "function", "", "", "", 2), ("c.py", "x", "x", "function", "", "loads it", "", 3)], "file string, name string, qualified_name string, kind string, signature string, summary string, docstring string, line long")
    got = events.foreign_symbols(s, spark.createDataFrame([(1, "load")], "query_id long, query string")).orderBy("position").collect()
    assert [(r["file"], r["rank"]) for r in got] == [("a.py", 0), ("b.py", 3), ("c.py", 3)]
    assert events.foreign_stats(s, spark.createDataFrame([("k", "v")], "key string, value string")).first()["files"] == 3


def test_usage_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from tessera.sources import adapters

    e = adapters.usage_events(spark, "/root/testdata/sf0.001").withColumns({c: F.col(c).cast("long") for c in ("result_count", "candidate_files", "returned_files")})
    e.repartition(3).write.parquet(str(tmp_path / "u"))
    q = usage.windowed(usage.stream(spark, str(tmp_path / "u")), "1 day", "3650 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(events) from w").first()[0] == batch.count()
    total = telemetry.usage_summary(e).where("total").first()
    assert spark.sql("select sum(estimated_saved_tokens) from w").first()[0] == total["estimated_saved_tokens"]


def test_configurations(spark, tmp_path):
    put(tmp_path, {"w/Team.json": json.dumps({"repos": ["/a/src/", " /b ", "/b"]}), "w/x.json": json.dumps({"name": " Two ", "repos": ["/c"], "schema_version": 1, "other": 5})})
    assert sorted((r["name"], r["repos"]) for r in events.workspaces(spark, str(tmp_path / "w")).collect()) == [("team", ["/a/src/", "/b"]), ("two", ["/c"])]
    got = events.workspace_repos(spark, str(tmp_path / "w"), "TEAM", ["/d", "/b/"]).orderBy("repo_index").collect()
    assert [(r["label"], r["root"], r["repo_index"]) for r in got] == [("a/src", "/a/src", 0), ("b", "/b", 1), ("d", "/d", 2)]
    with pytest.raises(FileNotFoundError):
        events.workspace_repos(spark, str(tmp_path / "w"), "none")
    with pytest.raises(ValueError):
        events.workspace_repos(spark)
    put(tmp_path, {"s/one.json": json.dumps({"repos": ["/a"], "symbol_queries": ["x", " x ", "", "X"]})})
    suite = events.suites(spark, str(tmp_path / "s")).first()
    assert (suite["name"], suite["symbol_queries"], suite["limit"], suite["repeat"]) == ("one", ["x", "X"], 20, 3)
    for wrong in ({"repos": ["/a"], "schema_version": 9}, {"repos": []}):
        put(tmp_path, {"bad/one.json": json.dumps(wrong)})
        with pytest.raises(PySparkException):
            events.suites(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_medians_are_exact_for_any_accuracy(spark, monkeypatch, accuracy):
    """Many values, ties, few values, nulls as key and as value, groups without values, infinities."""
    monkeypatch.setattr(measure, "ACCURACY", accuracy)
    rng = random.Random(4)
    values = {"many": [rng.gauss(0, 9) for _ in range(9001)], "even": [rng.random() for _ in range(4000)], "tied": [1.5] * 3000 + [2.5] * 2999, "two": [1.0, 4.0], "one": [7.0], None: [3.0, 1.0, 2.0], "none": [None, None], "gap": [0.0] * 500 + [1.0] * 500, "far": [float("-inf"), 2.0, float("inf")]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("two", None)]
    runs = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["n"], r["m"]) for r in measure.with_medians(runs.groupBy("k").agg(F.count("v").alias("n")), runs, ("k",), F.col("v"), "m").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        known = [v for v in vs if v is not None]
        assert got[k] == (len(known), pytest.approx(statistics.median(known)) if known else None)
    assert measure.with_medians(runs.limit(0).groupBy("k").agg(F.count("v").alias("n")), runs.limit(0), ("k",), F.col("v"), "m").count() == 0
