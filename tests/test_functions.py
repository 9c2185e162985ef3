"""Column functions, by example."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import bm25


def values(spark, rows, column, schema="a string, b string"):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_like_keeps_wildcards_and_backslashes(spark):
    rows = [("getXval", "get_v"), ("get_val", "GET_V"), ("get", "get_"), ("a\\b", "a\\b"), ("ab", "a\\b"), ("Äb", "äb"), ("50%", "5%%")]
    assert values(spark, rows, text.like(F.col("a"), F.col("b"))) == [True, True, False, True, False, False, True]


def test_query_variants(spark):
    rows = [("Hardware Capacity Planner", ""), ("Service", ""), ("a b", "")]
    got = values(spark, rows, text.query_variants(F.col("a")))
    assert got[0] == ["Hardware Capacity Planner", "HardwareCapacityPlanner", "hardwareCapacityPlanner", "hardware_capacity_planner", "hardware-capacity-planner", "hardwarecapacityplanner"]
    assert got[1] == ["Service"] and got[2] == ["a b", "AB", "aB", "a_b", "a-b", "ab"]


def test_query_terms(spark):
    rows = [(q, "") for q in ("load saved JSON snapshot from disk", "where are cached entries invalidated for a namespace", "strip whitespace from identifiers", "atomically publishes snapshots", "identifier", "the of", "x " * 300)]
    assert values(spark, rows, text.query_terms(F.col("a"))) == [["load", "saved", "json", "snapshot", "disk"], ["cached", "entry", "invalidated", "namespace"], ["strip", "whitespace", "identifier"], ["atomic", "publish", "snapshot"], [], [], []]


def test_reference_boundaries(spark):
    rows = [("x = Service()", "Service"), ("ServiceExtra", "Service"), ("a.b", "a.b"), ("aXb", "a.b"), ("service", "Service")]
    assert values(spark, rows, text.reference_match(F.col("a"), F.col("b"))) == [True, False, True, False, False]
    assert values(spark, rows[4:], text.reference_match(F.col("a"), F.col("b"), ignore_case=True)) == [True]


def test_redaction(spark):
    cases = {
        'API_TOKEN = "sk-abcdefghijklmnop"': 'API_TOKEN = "[REDACTED_SECRET]"',
        "Authorization: Bearer abcdefghijklmnop": "Authorization: Bearer [REDACTED_SECRET]",
        "x\n-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----\ny": "x\n[REDACTED_SECRET]\ny",
        "password: 'hunter2'": "password: '[REDACTED_SECRET]'",
        "tokens = 3": "tokens = 3",
    }
    assert values(spark, [(k, "") for k in cases], text.redact(F.col("a"))) == list(cases.values())
    assert [text.redact_text(k) for k in cases] == list(cases.values())


def test_line_counts_and_scores(spark):
    rows = [("", ""), ("a", ""), ("a\n", ""), ("a\nb", ""), (None, "")]
    assert values(spark, rows, text.line_count(F.col("a"))) == [0, 1, 1, 2, 0]
    rows = [("get = 1", "get"), ("getter", "get"), ("import a.get", "get"), ("x getter", "get"), ("y", "get"), ("Get: 1", "get")]
    assert values(spark, rows, text.text_line_score(F.col("a"), F.col("b"), F.lit(False))) == [0, 100, 200, 400, 800, 100]
    assert values(spark, [("aaaa", "aa"), ("a.b", "."), ("", "a")], text.occurrences(F.col("a"), F.col("b"))) == [3, 1, 0]


def test_identifier_words(spark):
    assert values(spark, [("invalidateHTTPResponse", ""), ("plain", ""), ("snake_case", "")], text.identifier_words(F.col("a"))) == ["invalidateHTTPResponse invalidate HTTP Response", "plain", "snake_case snake case"]


PATHS = ["tests/a.py", "test/a.py", "testing/a.py", "__tests__/a.js", "src/test_a.py", "src/a.test.js", "src/a.spec.ts", "src/a_test.py", "test_dir/a.py", "src/a.py", "mytests/a.py"]


@pytest.mark.parametrize(
    "flavor, expected",
    [("catalog", [0, 4, 5, 7]), ("lookup", [0, 1, 2, 3, 4, 5, 7]), ("context", [0, 1, 2, 3, 4, 5, 6, 7]), ("related", [0, 1, 3, 4, 5, 6]), ("risk", [0, 1, 3, 4, 5, 6]), ("benchmark", [0, 1, 3, 4, 5, 7]), ("documents", [0, 1, 2, 3, 4, 5, 7, 8])],
)
def test_seven_kinds_of_test_paths(spark, flavor, expected):
    assert [i for i, t in enumerate(values(spark, [(p, "") for p in PATHS], paths.is_test(F.col("a"), flavor))) if t] == expected


def test_path_parts(spark):
    assert values(spark, [("a/b.c.py", ""), (".env", ""), ("a/b/", "")], paths.stem(paths.basename(F.col("a")))) == ["b.c", ".env", "b"]
    assert values(spark, [("/x/app", ""), ("/x/app/src", ""), ("src", "")], paths.label(F.col("a"))) == ["app", "app/src", "src"]
    assert values(spark, [("a/b/c.py", ""), ("c.py", "")], paths.ancestors(F.col("a"), F.lit(5))) == [["a", "a/b"], []]


def test_stems_are_those_of_the_text_index():
    words = "caresses ponies caress cats feed agreed plastered motoring conflated troubled hopping falling filing happy sky relational conditional digitizer vietnamization operator decisiveness sensitiviti triplicate formalize electrical goodness revival allowance adjustable replacement adoption homologou effective probate rate controll roll namespace entries generalization apologi élève naïve x2y".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("create virtual table v using fts5vocab(t, row)")
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values(?)", (w,))
        assert [r[0] for r in db.execute("select term from v")] == [bm25.porter(bm25.bare(w))], w


def test_glob_patterns():
    from tessera.sources.discovery import glob_pattern

    for glob, yes, no in (("*.py", ["a.py", "x/a.py"], ["a.pyc"]), ("a?[bc]", ["axb"], ["axd"]), ("[!a]x", ["bx"], ["ax"])):
        assert all(re.match(glob_pattern(glob), y) for y in yes) and not any(re.match(glob_pattern(glob), n) for n in no)
