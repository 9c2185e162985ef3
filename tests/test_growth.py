"""Steps whose cost must grow no faster than their input."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import bm25, positions, search, trigrams
from tessera.plans import catalogue
from tessera.sources import adapters, extract, resolve
from tessera.sources.lines import indexed_lines


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_send_no_table_of_paths_to_the_driver(spark):
    imports = spark.createDataFrame([("r", "a/x.py", 0, ".y", "import"), ("r", "a/z.js", 0, "./w", "import")], "repo string, path string, ordinal int, name string, kind string")
    files = spark.createDataFrame([("r", "a/x.py"), ("r", "a/y.py"), ("r", "a/z.js"), ("r", "a/w.js")], "repo string, path string")
    out = resolve.resolve(imports, files, files)
    assert "Broadcast" not in plan(out)
    assert sorted(r["target_path"] for r in out.collect()) == ["a/w.js", "a/y.py"]


def test_made_sources_are_dealt_before_they_are_parsed(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK_FILES", 100)
    made = catalogue.made_sources(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == -(-made.count() // 100)


def test_redaction_of_strings_equals_that_of_columns(spark):
    texts = ["", "plain", "Bearer abcdefghijklmnop", "my_Token = 'x y'", "sk-abcdefghij", "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", 'API-KEY: "z"', "bearer", "api_key='q' ghp_" + "a" * 20]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", text.redact(F.col("t")).alias("r")).collect()
    assert [text.redact_text(r["t"]) for r in rows] == [r["r"] for r in rows]
    assert not text.ANY_SIGN.search("nothing of the kind")


def test_names_are_folded_once_and_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "ABCD", None), (2, "ab", "xabcx"), (3, "", "zz")], "k int, a string, b string")
    made = trigrams.name_grams(rows, ("k",), text.ascii_lower(F.col("a")), F.lower("b"))
    assert sorted(map(tuple, made.collect())) == [(1, "abc"), (1, "bcd"), (2, "abc"), (2, "bcx"), (2, "xab")]
    assert "Exchange" not in plan(made)
    logical = made._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("translate(") == 1  # once a text, not in the lambda of every run


def test_search_without_an_index_makes_the_asked_trigrams_only(spark):
    rows = spark.createDataFrame([("r", i, f"name_{i}", f"q.name_{i}", "sig", None, i, "p") for i in range(30)], "repo string, symbol_id int, name string, qualified_name string, signature string, doc string, line int, path string")
    queries = spark.createDataFrame([(1, "ame_2"), (2, "E_1"), (3, "sig"), (4, "e_")], "query_id long, query string")
    got = search.symbol_search(rows, queries, 9)
    with_index = search.symbol_search(rows, queries, 9, grams=search.symbol_grams(rows))
    key = lambda df: sorted((r["query_id"], r["position"], r["symbol_id"]) for r in df.collect())
    assert key(got) == key(with_index) and len(key(got)) == 36
    assert "array_intersect" in got._jdf.queryExecution().optimizedPlan().toString()


def test_extracted_columns_keep_their_types(spark):
    sources = spark.createDataFrame([("r", "a.py", "def f():\n    pass\n"), ("r", "b.css", ".c {}"), ("r", "d.py", None), ("r", "e.bin", "x")], "repo string, path string, content string")
    made = extract.extract(sources)
    assert sorted((r["path"], len(r["symbols"]), len(r["imports"])) for r in made.collect()) == [("a.py", 1, 0), ("b.css", 1, 0), ("d.py", 0, 0), ("e.bin", 0, 0)]


def test_each_step_of_redaction_is_evaluated_once(spark):
    made = spark.createDataFrame([("a",)], "t string").select(text.redact(F.upper("t")).alias("r"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_symbols_are_dealt_and_their_files_made_once(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "TASK_ROWS", 50)
    monkeypatch.setattr(adapters, "_PUBLISHED", {})
    parts = adapters.read(spark, sf, "part")
    assert adapters.dealt(parts, "p_partkey").rdd.getNumPartitions() == -(-parts.count() // 50)
    assert len(adapters.symbols(spark, sf).inputFiles()) > 1
    assert "Exchange" not in plan(adapters.symbol_files(spark, sf))


def test_names_that_hold_no_asked_text_make_no_trigrams(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "brand17.red"), (2, "brand9.blue"), (3, None), (4, "a red ring")], "k int, t string")
    asked = spark.createDataFrame([(7, "brand17."), (8, "red r")], "query_id long, q string")
    key = lambda df: sorted((r["k"], r["query_id"]) for r in df.collect())
    few = trigrams.holding(rows, asked, "q", F.col("t"))
    assert key(few) == [(1, 7), (1, 8), (4, 8)]  # not the other brand, though it has the same first trigram
    monkeypatch.setattr(trigrams, "FEW_TEXTS", 1)
    assert set(key(trigrams.holding(rows, asked, "q", F.col("t")))) >= {(1, 7), (4, 8)}


def test_postings_are_made_once_and_not_shuffled(spark):
    lines = spark.createDataFrame([("r", "p", i, f"line {i} of abcabc") for i in range(20)], "repo string, path string, line long, content string")
    own = positions.numbered(lines, chars=60, most=4)
    made = positions.postings(own, 3)
    assert "rangepartitioning(gram" not in plan(made) and made.rdd.getNumPartitions() == 3
    assert sorted(map(repr, made.collect())) == sorted(map(repr, positions.postings(own).collect()))


def test_trigrams_of_few_and_of_many_characters():
    many = "".join(map(chr, range(32, 1700)))
    for t in ("", "ab", "abcabc", "a\0\0a\0\0", "日本語ß日本語", many + many):
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        want = {}
        for i in range(len(t) - 2):
            want.setdefault(t[i : i + 3], []).append(i)
        names, places, ends = positions.by_gram(c, np.arange(max(len(c) - 2, 0)))
        got = {"".join(map(chr, g)): p.tolist() for g, p in zip(names.tolist(), np.split(places, ends[:-1]), strict=False)}
        assert got == want and list(got) == sorted(got)


def test_parts_are_held_by_what_signs_match(spark):
    for texts, parts in zip((["-----BEGIN "], ["sk-", "ghs_", "xoxr-", "AKIA", "AIza"], ["bearer", "BEARER"], ["Secret", "TOKEN", "passw", "API_key", "apikey"]), text.PARTS, strict=True):
        assert all(any(p in (t if t in parts else t.lower()) for p in parts) for t in texts)


def test_lines_are_cut_without_a_search_for_the_last_end(spark):
    texts = ["a\n", "a\r\n", "a\r\nb\u2028\n", "\n\na", "", "a\n\n"]
    sources = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, path string, content string")
    made = indexed_lines(sources)
    assert sorted((r["path"], r["line"], r["content"]) for r in made.collect()) == [("0", 1, "a"), ("1", 1, "a"), ("2", 1, "a"), ("2", 2, "b"), ("3", 3, "a"), ("5", 1, "a")]
    assert "\\z" not in made._jdf.queryExecution().optimizedPlan().toString()


def code(spark):
    symbols = spark.createDataFrame(
        [("r", i, f"red_widget_{i}", f"q.red_widget_{i}", "function" if i % 2 else "class", f"src/{i % 3}.py", i * 10, i * 10 + 4, "red ring", "Makes rings, thé widgets" if i % 5 else None, None) for i in range(40)],
        "repo string, symbol_id long, name string, qualified_name string, kind string, path string, line long, end_line long, signature string, doc string, full_doc string",
    )
    lines = spark.createDataFrame([("r", f"src/{p}.py", n, f"ringing widget_{n} things" if n % 3 else "thing") for p in (0, 1, 9) for n in range(0, 400, 2)], "repo string, path string, line long, content string")
    return symbols, lines


def test_postings_are_counted_where_documents_lie(spark):
    documents = spark.createDataFrame([("r", 1, "p", "Rings ring", "a", None, ""), ("r", 2, "p", "", None, "", "ringing ringed, é")], "repo string, symbol_id long, path string, name string, signature string, doc string, body string")
    made = bm25.postings(documents)
    assert "Exchange" not in plan(made)
    assert sorted(map(tuple, made.collect())) == [("r", 1, "p", "name", "ring", 2), ("r", 1, "p", "signature", "a", 1), ("r", 2, "p", "body", "e", 1), ("r", 2, "p", "body", "ring", 2)]
    assert sorted(r["term"] for r in bm25.postings(documents, stemmed=False).collect()) == ["a", "ring", "ringed", "ringing", "rings", "é"]


def test_lines_of_files_without_symbols_are_not_moved(spark, monkeypatch):
    symbols, lines = code(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    some = rows(bm25.function_documents(symbols, lines))
    assert any(r[-1] for r in some)
    assert "Exchange" not in plan(bm25.function_documents(symbols, lines.where("path = 'src/9.py'")))
    monkeypatch.setattr(bm25, "MOST_FILES", 0)
    assert rows(bm25.function_documents(symbols, lines)) == some


def test_files_with_lines_and_symbols_are_found_without_a_broadcast(spark, tmp_path):
    symbols, lines = code(spark)
    symbols.write.parquet(str(tmp_path / "s"))  # small enough for a broadcast by its size on disk
    lines = lines.union(spark.createDataFrame([(None, "src/0.py", 1, "x")], lines.schema))
    found = bm25.in_both(lines, spark.read.parquet(str(tmp_path / "s")))
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("r", "src/0.py"), ("r", "src/1.py")]


def test_a_scan_of_documents_finds_what_postings_do(spark, monkeypatch):
    documents = bm25.function_documents(*code(spark))
    queries = spark.createDataFrame([(1, ["red", "thing"]), (2, ["widget", "ringing", "the"]), (3, ["no", "such"]), (4, ["red"])], "query_id long, terms array<string>")
    index = bm25.postings(documents)
    rows = lambda index, *how: sorted(map(tuple, bm25.search_documents(index, queries, 9, *how).collect()))
    for how in ((True, True), (False, True), (True, False)):
        want = rows(index, *how)
        assert rows(bm25.Documents(documents), *how) == want and {r[0] for r in want} >= {2}
    assert [r["stem"] for r in bm25.scan(documents, bm25.asked(queries, True)[0].where("query_id = 4"))[0].select("stem").distinct().collect()] == ["red"]
    monkeypatch.setattr(bm25, "MOST_TERMS", 0)
    monkeypatch.setattr(bm25, "MOST_KNOWN", 0)
    assert rows(bm25.Documents(documents)) == rows(index)


def test_other_line_ends_are_met_without_a_class_of_characters(spark):
    texts = ["a\nb", "", "\n", "a\r\nb\rc", "a\vb\fc", "a\x1cb\x1dc\x1ed", "é\x85b\u2028c\u2029", "[]|", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.split_lines(F.col("t")), F.split("t", text.LINE_END, -1)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and len(text.OTHER_ENDS) == 9
    assert "RLIKE" not in spark.createDataFrame([("a",)], "t string").select(text.split_lines(F.upper("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_ascii_is_folded_without_a_table(spark):
    texts = ["ABCxyz-09", "", "ÀÉ İA", "Kelvin \u212a", "日本A", None]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(text.ascii_lower(F.col("t")).alias("a"), F.translate("t", text.UPPER, text.LOWER).alias("b"))
    assert all(r["a"] == r["b"] for r in made.collect())
    assert "octet_length" in made._jdf.queryExecution().optimizedPlan().toString()
