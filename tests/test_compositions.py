"""Queries that SQL of the other engine can't say, against an index of SQLite's or against their parts put together by hand."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, context, lookup, search
from tessera.plans import catalogue
from tessera.sources import adapters as a
from tessera.sources import shared

SF = "/root/testdata/sf0.001"


def test_stemmed_ranking_equals_fts5(spark):
    """The same documents, weights, test filter and cut in SQLite's own full-text index."""
    documents = bm25.function_documents(a.symbols(spark, SF), catalogue.symbol_lines(spark, SF)).collect()
    index = bm25.postings(bm25.function_documents(a.symbols(spark, SF), catalogue.symbol_lines(spark, SF)))
    asked = [*catalogue.TERM_QUERIES, (9, "making blue rings"), (10, "rings made largely of bolts tiny")]
    queries = a.queries(spark, asked).select("query_id", text.query_terms(F.col("query")).alias("terms"))
    got = {}
    for r in bm25.search_documents(index, queries, 15).collect():
        got.setdefault((r["query_id"], r["repo"]), []).append((r["position"], r["symbol_id"], r["bm25"]))
    compared = 0
    for repo in {d["repo"] for d in documents}:
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table t using fts5(path unindexed, name, signature, doc, body, tokenize='porter unicode61 remove_diacritics 2')")
        for d in documents:
            if d["repo"] == repo:
                db.execute("insert into t(rowid, path, name, signature, doc, body) values (?,?,?,?,?,?)", tuple(d[c] for c in ("symbol_id", "path", "name", "signature", "doc", "body")))
        for q in queries.collect():
            if len(q["terms"]) < 2:
                continue
            match = "{name signature doc body} : (" + " OR ".join(f'"{t}"' for t in q["terms"]) + ")"
            best = db.execute("select rowid, bm25(t, 0, 8, 3, 5, 1) as s, path from t where t match ? order by s, rowid limit 64", (match,)).fetchall()
            covered = lambda i: sum(db.execute("select count(*) from t where t match ? and rowid = ?", ('{name signature doc body} : "%s"' % t, i)).fetchone()[0] for t in q["terms"])  # noqa: B023, E731
            kept = [(s, path, i) for i, s, path in best if covered(i) >= max(2, (len(q["terms"]) + 2) // 3)]
            want = [i for _, _, i in sorted((round(s, 9), p, i) for s, p, i in kept)][:15]
            mine = sorted(got.get((q["query_id"], repo), []))
            scores = {i: s for s, _, i in kept}
            assert len(mine) == len(want)
            assert all(abs(scores[i] - s) < 1e-9 for _, i, s in mine)
            assert [i for _, i, _ in mine] == want
            compared += len(want)
    assert compared > 100


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_workspace_lookup_is_its_repositories_merged(spark):
    queries = a.queries(spark, [*catalogue.SYMBOL_QUERIES[:3], (8, "license"), (9, "qqq none")])
    tables = (a.symbols(spark, SF), a.files(spark, SF), a.text_lines(spark, SF))
    limits = dict(symbol_limit=None, file_limit=None, include_tests=True)
    each = rows_of(lookup.lookup(*tables, queries, lookup.Limits(limit=8, text_limit=0, **limits)))
    text_only = rows_of(lookup.lookup(*tables, queries, lookup.Limits(limit=5, symbol_limit=0, file_limit=0, text_limit=5, recover=False)))
    found = {r["query_id"] for r in each}
    hits = each + [r for r in text_only if r["query_id"] not in found]
    repos = spark.createDataFrame([(f"r{i}", f"l{3 - i}", i) for i in range(4)], "repo string, label_of_repo string, repo_index long")
    got = rows_of(lookup.workspace_lookup(*tables, queries, repos, lookup.Limits(limit=12, text_limit=0, fallback_text_limit=5), 8))
    for q in {r["query_id"] for r in hits}:
        order = lambda r: (r["score"] + int(r["repo"][1]), f"l{3 - int(r['repo'][1])}", r["path"], r["line"], r["kind"])
        want = [(*order(r), r["label"]) for r in sorted((r for r in hits if r["query_id"] == q), key=order)][:12]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["position"])
        assert [(r["score"], r["label_of_repo"], r["path"], r["line"], r["kind"], r["label"]) for r in mine] == want
    assert {r["query_id"] for r in got} == {r["query_id"] for r in hits} >= {8} and 9 not in {r["query_id"] for r in got}


def test_recovery_goes_before_what_names_find(spark):
    index = a.function_terms(spark, SF)
    queries = a.queries(spark, [(1, "red_widget_7"), (2, "red things widgets"), (3, "where are small rings"), (4, "license")])
    tables = (a.symbols(spark, SF), catalogue.all_files(spark, SF), a.text_lines(spark, SF))
    plain = rows_of(lookup.lookup(*tables, queries, lookup.Limits(limit=12, recover=False)))
    terms = queries.select("query_id", text.query_terms(F.col("query")).alias("terms"))
    ranked = rows_of(bm25.search_documents(index, terms, 12))
    places = {(r["repo"], r["symbol_id"]): r for r in rows_of(a.symbols(spark, SF))}
    got = rows_of(lookup.lookup(*tables, queries, lookup.Limits(limit=12), index))
    named = {(r["query_id"], r["repo"]) for r in plain if r["kind"] in ("symbol", "file")}
    recovered = 0
    for q in range(1, 5):
        for repo in {r["repo"] for r in plain} | {r["repo"] for r in ranked}:
            of = lambda rows: sorted((r for r in rows if r["query_id"] == q and r["repo"] == repo), key=lambda r: r["position"])  # noqa: B023, E731
            rest = of(plain)
            front = [] if (q, repo) in named or q in (1, 4) else [(899 + r["position"], places[repo, r["symbol_id"]]) for r in of(ranked)]
            at = {(s["path"], s["line"]) for _, s in front}
            want = [(score, s["path"], s["line"]) for score, s in front] + [(r["score"], r["path"], r["line"]) for r in rest if (r["path"], r["line"]) not in at]
            assert [(r["score"], r["path"], r["line"]) for r in of(got)] == want[:12]
            recovered += len(front)
    assert recovered > 0


def test_context_of_symbols_by_hand(spark):
    symbols, files, lines = a.symbols(spark, SF), a.symbol_files(spark, SF), catalogue.symbol_lines(spark, SF)
    hits = lookup.lookup(symbols, files, lines, a.queries(spark, catalogue.SYMBOL_QUERIES[:3]), lookup.Limits(limit=8))
    hits = shared.stored(hits, "hits")
    content = {(r["repo"], r["path"], r["line"]): r["content"] for r in lines.collect()}
    own = {(s["repo"], s["path"], s["line"]): s for s in symbols.collect()}
    windows = {}
    order = {}
    for h in sorted(hits.collect(), key=lambda r: (r["query_id"], r["repo"], r["position"])):
        key = (h["query_id"], h["repo"])
        files_of = order.setdefault(key, [])
        if h["path"] not in files_of:
            files_of.append(h["path"])
        if files_of.index(h["path"]) >= 5:
            continue
        spans = windows.setdefault((*key, h["path"]), [])
        if h["kind"] == "symbol":
            start = max(1, h["line"] - 2)
            s = own.get((h["repo"], h["path"], h["line"]))
            end = h["end_line"] or (s and s["end_line"])
            end = min(500, max(end, h["line"]), start + 79) if end else min(500, h["line"] + 4)
            spans.append((start, max(start, end)))
        elif h["kind"] == "text":
            spans.append((max(1, h["line"] - 4), min(500, h["line"] + 4)))
        else:
            spans.append(None)
    want = set()
    for (q, repo, path), spans in windows.items():
        if None in spans:
            continue  # windows of whole files are the SQL queries' business
        merged = []
        for s in sorted(spans):
            if merged and s[0] <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(merged[-1][1], s[1]))
            else:
                merged.append(s)
        left = 80
        for start, end in merged:
            if left > 0:
                end = min(end, start + left - 1)
                left -= end - start + 1
                want.add((q, repo, path, start, end, "\n".join(content.get((repo, path, i), "") for i in range(start, end + 1))))
    got = {(r["query_id"], r["repo"], r["path"], r["start_line"], r["end_line"], r["content"]) for r in context.context_pack(hits, files, symbols, lines).collect()}
    assert want and want <= got


def test_batch_and_compact_payloads(spark):
    import json

    rows = [(1, "r1", "a.py", 1, 2, [1], "x\ny"), (2, "r1", "a.py", 1, 2, [2], "x\ny"), (2, "r0", "b.py", 5, 5, [5], "zé")]
    snippets = spark.createDataFrame(rows, "query_id long, repo string, path string, start_line long, end_line long, hit_lines array<long>, content string")
    repos = spark.createDataFrame([("r0", 0), ("r1", 1)], "repo string, repo_index long")
    got = {r["query_id"]: r for r in context.compact(snippets, repos).collect()}
    assert [x["repo_index"] for x in json.loads(got[2]["payload"])] == [0, 1] and got[2]["bytes"] == len(got[2]["payload"].encode())
    queries = spark.createDataFrame([(1, "X"), (2, "y"), (3, " x ")], "query_id long, query string")
    best = context.batch(snippets, repos, queries).collect()
    assert len(best) == 1 and best[0]["form"] == "shared"
    assert sorted(tuple(x["queries"]) for x in json.loads(best[0]["payload"])) == [(1, 2, 3), (2,)]


def test_more_queries_than_are_sent(spark, monkeypatch):
    want = sorted(map(tuple, catalogue.symbol_fuzzy(spark, SF).collect()))
    monkeypatch.setattr(search, "MOST_QUERIES", 2)
    assert sorted(map(tuple, catalogue.symbol_fuzzy(spark, SF).collect())) == want


def test_suite_history(spark, tmp_path):
    from tessera.operators import measure

    card = lambda n: spark.createDataFrame([("p", n, 2.5), ("q", 1, None)], "provider string, hits long, ms double")
    first = {r["provider"]: r for r in measure.record_run(card(3), str(tmp_path / "h"), "s", ("hits", "ms")).collect()}
    assert first["p"]["hits_delta"] is None
    measure.record_run(card(9), str(tmp_path / "h"), "other", ("hits", "ms"))
    second = {r["provider"]: r for r in measure.record_run(card(5), str(tmp_path / "h"), "s", ("hits", "ms")).collect()}
    assert (second["p"]["hits_delta"], second["p"]["ms_delta"]) == (2.0, 0.0)
    assert spark.read.json(str(tmp_path / "h")).count() == 6


def test_benchmark_of_providers(spark):
    from tessera.operators import measure, providers

    find = lambda p, fuzzy: lambda: providers.find(a.queries(spark, [(1, "red_w")]), a.symbols(spark, SF), provider="catalog", fuzzy=fuzzy)  # noqa: ARG005, E731
    got = measure.benchmark({("all", 1, "red_w"): find("all", True), ("exact", 1, "red_w"): find("exact", False)}, spark, repeat=2, warmup=0)
    card = {r["provider"]: r for r in measure.symbol_scorecard(got, "exact").collect()}
    assert card["exact"]["speedup"] is None and card["all"]["speedup"] > 0 and card["all"]["results"] >= card["exact"]["results"] > 0


@pytest.mark.parametrize("named, provider", [(None, "catalog"), ("FOREIGN ", "foreign"), ("other", "catalog")])
def test_default_provider(monkeypatch, named, provider):
    from tessera.operators import providers

    monkeypatch.delenv(providers.VARIABLE, raising=False)
    if named:
        monkeypatch.setenv(providers.VARIABLE, named)
    assert providers.default_provider() == provider
    assert providers.providers_of("x, foreign,catalog,FOREIGN") == ["foreign", "catalog"] and providers.providers_of("") == ["catalog", "foreign"]
    with pytest.raises(ValueError):
        providers.find(None, None, provider="none")


def test_stored_tables_are_removed(spark, tmp_path):
    before = list(shared.WRITTEN)
    shared.WRITTEN.clear()
    try:
        made = shared.stored(spark.range(3), "x")
        assert made.count() == 3 and shared.clear(spark) == 1 and not shared.WRITTEN
        with pytest.raises(Exception, match="not exist|NOT_EXIST|FILE"):
            made.count()
    finally:
        shared.WRITTEN.extend(before)


def test_suite_run_and_workflow(spark, tmp_path):
    from tessera.operators import measure, providers

    make = lambda fuzzy: lambda q: providers.find(a.queries(spark, [(1, q)]), a.symbols(spark, SF), provider="catalog", fuzzy=fuzzy)
    run = lambda: {r["provider"]: r for r in measure.run_suite(spark, "s", ["red_w", "zzz"], {"exact": make(False), "all": make(True)}, str(tmp_path / "h"), 1, 0).collect()}
    first, second = run(), run()
    assert first["all"]["queries"] == 2 and first["all"]["results_delta"] is None and second["all"]["results_delta"] == 0.0
    hits = catalogue.workspace_hits(spark, SF).where("position <= 10")
    snippets = catalogue.workspace_snippets(spark, SF)
    repos = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "repo string, repo_index long")
    times = hits.select("query_id").distinct().withColumn("elapsed_ms", F.col("query_id") * 2.0)
    runs = measure.workflow_runs(times, hits, context.pack_totals(hits, snippets, a.files(spark, SF)), context.compact(snippets, repos))
    card = measure.workflow_scorecard(runs).first()
    totals = catalogue.workspace_pack_totals(spark, SF).collect()
    assert card["queries"] == len(totals) and card["selected_lines_total"] == sum(r["selected_lines"] for r in totals)
    assert card["payload_bytes_total"] == sum(r["bytes"] for r in catalogue.compact_pack(spark, SF).collect()) and card["first_paths"].count(",") == len(totals) - 1
    assert measure.workflow_scorecard(runs.limit(0)).first()["queries"] == 0
