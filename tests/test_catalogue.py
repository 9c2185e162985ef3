"""Extraction, resolution, search, lookup, context and graph on small trees."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, context, graph, lookup, references, search
from tests.repos import SERVICE, catalog, queries


@pytest.fixture(scope="module")
def service(spark):
    return catalog(spark, SERVICE)


def test_extracted(spark, service):
    names = {(r["path"], r["kind"], r["qualified_name"], r["line"]) for r in service.symbols.collect()}
    assert ("src/app/service.py", "class", "Service", 1) in names and ("src/app/service.py", "method", "Service.run", 2) in names
    edges = {(r["source_path"], r["target_path"], r["category"]) for r in service.dependencies.collect()}
    assert edges == {("src/app/api.py", "src/app/service.py", "code"), ("tests/test_service.py", "src/app/service.py", "code")}


def test_languages(spark):
    c = catalog(spark, {
        "a/x.py": "import os\nimport requests\nfrom . import y\nfrom .missing import z\nTOKEN = \"sk-abcdefghijklmnop\"\n_PRIVATE = 1\nA, (B, c) = 1, (2, 3)\n\ndef many(\n    a: int,\n    b=':',  # a comment:\n) -> bool:\n    \"\"\"Doc.\n\n    More.\"\"\"\n",
        "a/y.py": "x = (", "w.jsx": "import logo from './logo.svg?url';\nimport {a} from '@s/p/q';\nimport './gone';\nconst q = require('./u');\nexport const useThing = () => 1;\nexport default memo(function Card() {});\nconst LIMIT = 3;\nexport function Card() {}\nfunction _hidden() {}\n",
        "u.ts": "export type T = 1;", "logo.svg": "<svg/>", "s.css": ".panel { }\n.panel .x {}\n@keyframes fade-in {}\n",
    })
    got = {(r["path"], r["name"]): r for r in c.symbols.collect()}
    assert {n for p, n in got if p == "a/x.py"} == {"TOKEN", "A", "B", "many"}
    assert got["a/x.py", "TOKEN"]["signature"] == 'TOKEN = "[REDACTED_SECRET]"'
    assert got["a/x.py", "many"]["signature"].endswith(") -> bool:") and got["a/x.py", "many"]["doc"] == "Doc."
    assert got["w.jsx", "useThing"]["kind"] == "hook" and got["w.jsx", "Card"]["kind"] == "component" and got["w.jsx", "Card"]["line"] == 6
    assert not got["w.jsx", "_hidden"]["exported"] and got["w.jsx", "LIMIT"]["kind"] == "constant" and got["u.ts", "T"]["kind"] == "type"
    assert {n for p, n in got if p == "s.css"} == {".panel", ".x", "@keyframes fade-in"}
    edges = {(r["source_path"], r["import_name"]): (r["target_path"], r["category"], r["resolved"]) for r in c.dependencies.collect()}
    assert edges == {
        ("a/x.py", "os"): ("os", "stdlib", False), ("a/x.py", "requests"): ("requests", "external", False), ("a/x.py", ".y"): ("a/y.py", "code", True), ("a/x.py", ".missing"): ("missing", "unresolved", False),
        ("w.jsx", "./logo.svg?url"): ("logo.svg", "asset", False), ("w.jsx", "@s/p/q"): ("@s/p", "external", False), ("w.jsx", "./gone"): ("./gone", "unresolved", False), ("w.jsx", "./u"): ("u.ts", "code", True),
    }


def test_lookup_of_a_class(spark, service):
    hits = lookup.lookup(service.symbols, service.files, service.lines, queries(spark, "Service")).orderBy("position").collect()
    assert [(h["kind"], h["path"], h["line"], h["score"]) for h in hits] == [
        ("symbol", "src/app/service.py", 1, 0), ("symbol", "src/app/service.py", 2, 301), ("file", "src/app/service.py", 1, 500), ("file", "tests/test_service.py", 1, 651),
        ("text", "src/app/api.py", 1, 1980), ("text", "src/app/api.py", 4, 1981),
    ]


def test_exact_name_before_the_limit(spark):
    c = catalog(spark, {"a.py": "\n".join(f"def get_{i:03}(): pass" for i in range(100)) + "\ndef get(): pass\n"})
    rows = search.symbol_search(c.symbols, queries(spark, "get"), 5).orderBy("position").collect()
    assert rows[0]["name"] == "get" and len(rows) == 5


def test_text_prefers_definitions_and_sources(spark):
    c = catalog(spark, {"tests/test_a.py": "LIMIT = 1\n", "zzz/a.py": "x = 'say LIMIT'\nLIMIT = 2\n"})
    rows = search.text_search(c.lines, queries(spark, "LIMIT"), 5).orderBy("position").collect()
    assert [(r["path"], r["line"], r["line_score"]) for r in rows] == [("zzz/a.py", 2, 0), ("zzz/a.py", 1, 400), ("tests/test_a.py", 1, 1000)]
    with_snippets = search.with_context(search.text_search(c.lines, queries(spark, "LIMIT"), 1), c.lines, 1).first()
    assert with_snippets["snippet"] == "1: x = 'say LIMIT'\n2: LIMIT = 2" and (with_snippets["start_line"], with_snippets["end_line"]) == (1, 2)
    with pytest.raises(ValueError):
        search.text_search(c.lines, queries(spark, " "))


def test_references(spark):
    c = catalog(spark, {"back/service.py": "class Service:\n    pass\n\nclass ServiceExtra:\n    pass\n", "back/use.py": "from back.service import Service\nx = Service()\n"})
    rows = references.references(c.lines, c.symbols, queries(spark, "Service")).orderBy("score").collect()
    assert [(r["path"], r["line"], r["kind"], r["symbol_kind"]) for r in rows] == [("back/service.py", 1, "definition", "class"), ("back/use.py", 1, "reference", ""), ("back/use.py", 2, "reference", "")]
    roll = references.by_file(references.references(c.lines, c.symbols, queries(spark, "Service"))).orderBy("path").collect()
    assert [(r["path"], r["match_count"], r["definition_count"], r["first_line"]) for r in roll] == [("back/service.py", 1, 1, 1), ("back/use.py", 2, 0, 1)]


def test_blast_and_tests(spark, service):
    target = spark.createDataFrame([("r", "src/app/service.py")], "repo string, target string")
    tests = graph.related_tests(service.files, service.dependencies, service.symbols, service.sources, target)
    assert [r["reason"] for r in tests.collect()] == ["imports source file, mentions source symbol, name matches source file"]
    reached = graph.dependents(graph.internal_edges(service.dependencies, service.files), target)
    row = graph.change_report(reached, tests, target).first()
    assert (row["direct"], row["transitive"], row["tests"], row["score"], row["label"]) == (2, 0, 1, 4.5, "low")
    assert graph.risk(service.files, service.dependencies, service.symbols, service.sources, 1).first()["target"] == "src/app/service.py"


def test_generic_names_need_a_common_folder(spark):
    c = catalog(spark, {"src/one/client.py": "x = 1", "src/two/client.py": "x = 1", "tests/one/test_client.py": "", "tests/two/test_client.py": ""})
    got = graph.related_tests(c.files, c.dependencies, c.symbols, c.sources, spark.createDataFrame([("r", "src/one/client.py")], "repo string, target string"))
    assert [r["path"] for r in got.collect()] == ["tests/one/test_client.py"]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("r", *e) for e in [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")]], "repo string, source_path string, target_path string")
    got = graph.dependents(edges, spark.createDataFrame([("r", "a")], "repo string, target string"))
    assert sorted((r["path"], r["depth"]) for r in got.collect()) == [("b", 1), ("c", 2), ("d", 3)]


RECOVERY = {
    "cache.py": 'def invalidateHTTPResponse(key):\n    """Drop one response.\n\n    Expired entries of a namespace go too.\n    """\n    return key\n',
    "noise.py": "".join(f"def noise_{i}(value):\n    return value + {i}\n\n" for i in range(40)),
    "snapshots.py": 'def load_snapshot(path):\n    """Load a saved JSON snapshot from disk."""\n    return path\n',
}


def test_words_find_what_names_do_not(spark):
    c = catalog(spark, RECOVERY)
    index = bm25.postings(bm25.function_documents(c.symbols, c.lines))
    q = queries(spark, "expired response namespace", "load saved JSON snapshot from disk", "zebra quantum flux")
    rows = lookup.lookup(c.symbols, c.files, c.lines, q, lookup.Limits(limit=3), index).where("position = 1").collect()
    assert {r["query_id"]: r["path"] for r in rows} == {1: "cache.py", 2: "snapshots.py"}
    ranked = bm25.keyword_rank(c.symbols, spark.createDataFrame([(1, ["load", "snapshot", "disk"])], "query_id long, terms array<string>"), c.lines)
    assert ranked.first()["path"] == "snapshots.py"


def test_bm25_equals_the_text_index(spark):
    import sqlite3

    c = catalog(spark, RECOVERY)
    docs = bm25.function_documents(c.symbols, c.lines)
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, name, signature, doc, body, tokenize='porter unicode61 remove_diacritics 2')")
    for r in docs.collect():
        db.execute("insert into t(path, name, signature, doc, body) values(?,?,?,?,?)", (r["path"] + r["name"], r["name"], r["signature"], r["doc"], r["body"]))
    want = sorted(round(r[0], 9) for r in db.execute("select bm25(t, 0, 8, 3, 5, 1) from t where t match '\"load\" OR \"snapshot\" OR \"value\"' order by 1 limit 64"))
    terms = spark.createDataFrame([(1, ["load", "snapshot", "value"])], "query_id long, terms array<string>")
    got = bm25.search_documents(bm25.postings(docs), terms, 64).collect()
    assert got and {round(r["bm25"], 9) for r in got} <= set(want)


def test_windows(spark):
    w = spark.createDataFrame([("f", 10, 20), ("f", 21, 25), ("f", 40, 60), ("g", 1, 2)], "f string, start_line long, end_line long")
    merged = context.merged(w, ("f",))
    assert sorted(tuple(r) for r in merged.collect()) == [("f", 10, 25), ("f", 40, 60), ("g", 1, 2)]
    assert sorted(tuple(r) for r in context.budgeted(merged, 30, ("f",)).collect()) == [("f", 10, 25), ("f", 40, 53), ("g", 1, 2)]


def test_context_pack(spark, service):
    hits = lookup.lookup(service.symbols, service.files, service.lines, queries(spark, "Service"))
    rows = context.context_pack(hits, service.files, service.symbols, service.lines, max_files=2, around=1).orderBy("path").collect()
    assert [r["path"] for r in rows] == ["src/app/service.py", "tests/test_service.py"]
    assert rows[0]["content"] == "class Service:\n    def run(self):\n        return 1" and rows[0]["hit_lines"] == [1, 2, 1]
    source_only = context.context_pack(hits, service.files, service.symbols, service.lines, max_files=2, around=1, include_tests=False)
    assert {r["path"] for r in source_only.collect()} == {"src/app/service.py", "src/app/api.py"}


def test_workspace_falls_back_to_text(spark):
    c = catalog(spark, {"one": {"a.py": "x = 'rare words here'\n"}, "two": {"b.py": "def other(): pass\n"}})
    repos = spark.createDataFrame([("one", "one", 0), ("two", "two", 1)], "repo string, label_of_repo string, repo_index long")
    limits = lookup.Limits(text_limit=0, fallback_text_limit=5)
    rows = lookup.workspace_lookup(c.symbols, c.files, c.lines, queries(spark, "rare words", "other"), repos, limits).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["kind"], r["repo"]) for r in rows] == [(1, "text", "one"), (2, "symbol", "two")]


def test_innermost(spark, service):
    places = service.files.select("repo", "path", F.lit(3).cast("long").alias("at"))
    got = bm25.innermost(service.symbols, places).join(service.symbols.select("symbol_id", "name"), "symbol_id").where("path = 'src/app/service.py'")
    assert [r["name"] for r in got.collect()] == ["run"]


@pytest.mark.parametrize("seed", range(6))
def test_reach_equals_a_walk(seed):
    import random

    from tessera.operators import graph

    rng = random.Random(seed)
    n = rng.choice([1, 5, 30, 60])
    near = [sorted({rng.randrange(n) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))}) for _ in range(n)]
    want = []
    for node in range(n):
        seen, todo = set(near[node]), list(near[node])
        while todo:
            for other in near[todo.pop()]:
                if other not in seen and other != node:
                    seen.add(other)
                    todo.append(other)
        want.append((len(near[node]), len(seen - set(near[node]))))
    assert graph.reach(near) == want == graph.reach(near, least=7, bits=1)


def test_counts_of_reach_equal_the_rows(spark):
    from tessera.operators import graph
    from tessera.sources import adapters as a

    sf = "/root/testdata/sf0.001"
    edges = graph.internal_edges(a.dependencies(spark, sf), a.files(spark, sf)).union(spark.createDataFrame([("x", "a", "a"), ("x", "b", "a"), ("x", "a", "b"), ("x", "c", "b")], "repo string, source_path string, target_path string"))
    targets = edges.select("repo", edges["target_path"].alias("target")).distinct()
    rows = graph.dependents(edges, targets).selectExpr("repo", "target", "depth = 1 AS direct").groupBy("repo", "target").pivot("direct", [True, False]).count().na.fill(0)
    want = {(r["repo"], r["target"]): (r["true"], r["false"]) for r in rows.collect()}
    got = {(r["repo"], r["target"]): (r["direct"], r["transitive"]) for r in graph.reach_counts(edges).where("direct > 0").collect()}
    assert got == want


def test_lines_and_spans_of_one_large_file_meet_by_bins(spark):
    """A million lines and 100,000 symbols in a file: each line meets the few symbols around it."""
    places = spark.range(1, 1_000_001).select(F.lit("r").alias("repo"), F.lit("big.py").alias("path"), F.col("id").alias("at"))
    symbols = spark.range(100_000).select(F.lit("r").alias("repo"), F.lit("big.py").alias("path"), F.col("id").alias("symbol_id"), (F.col("id") * 10 + 1).alias("line"), (F.col("id") * 10 + F.when(F.col("id") % 3 == 0, 25).otherwise(8)).alias("end_line"))
    got = bm25.innermost(symbols, places).agg(F.count("*").alias("n"), F.sum(F.when(F.col("symbol_id") == F.floor((F.col("at") - 1) / 10), 1)).alias("own")).first()
    lines = spark.range(1, 1_000_001)
    around = lambda i: [k for k in range(max(0, (i - 1) // 10 - 3), (i - 1) // 10 + 1) if k * 10 + 1 <= i <= k * 10 + (25 if k % 3 == 0 else 8)]
    first = {r["at"]: r["symbol_id"] for r in bm25.innermost(symbols, places.where("at <= 200")).collect()}
    assert first == {i: min(k, key=lambda x: (24 if x % 3 == 0 else 7, x)) for i in range(1, 201) if (k := around(i))}
    assert 0 < got["own"] <= got["n"] <= lines.count()
