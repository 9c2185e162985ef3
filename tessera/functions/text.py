"""Column functions over text: case folding, patterns, identifiers, query words, redaction, lines, tokens.

All are compositions of Spark's built-in functions, so they stay inside generated code and can be pushed or pruned. The
few Python functions beside them apply the same rules to strings that a Python-bound extractor holds already.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "[REDACTED_SECRET]"
#: Patterns of secrets and what replaces them ($n: what the n-th group matched). Blocks come first: they span lines.
SECRETS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", MARK),
    (r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,})", MARK),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/-]{12,}=*", "$1" + MARK),
    (r"(?i)([A-Za-z0-9_]*(?:secret|token|password|passwd|api_?key)[A-Za-z0-9_]*[\"']?\s*[:=]\s*)([\"'])[^\"'\n]+([\"'])", "$1$2" + MARK + "$3"),
)
#: What any match of each holds.
SIGNS = ("-----BEGIN ", "sk-|gh[pousr]_|xox[abprs]-|AKIA|AIza", "(?i)bearer", "(?i)secret|token|passw|api_?key")
#: The same as plain parts, of which such a match holds one (of the text in lower case): they are found several times faster.
PARTS = (
    ("-----BEGIN ",),
    ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AKIA", "AIza"),
    ("bearer",),
    ("secret", "token", "passw", "apikey", "api_key"),
)
#: What ends a line where lines are indexed; line counts know \n only.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
#: What a text holds that has other line ends than \n: characters are found several times faster than a class of them.
OTHER_ENDS = tuple(LINE_END.split("|", 1)[1].strip("[]").replace("\n", "", 1))
#: Words that a query's terms leave out.
STOP_WORDS = (
    "a an and are as at be before by can code could do does find for from function functions get give how i in into is "
    "it locate me method methods missing of on or our please provide return returns show supplies supply tell that the "
    "their these this to using value values want what when where which with without"
).split()
MOST_TERMS, MOST_VARIANTS = 8, 6


def ascii_lower(c: Column) -> Column:
    """Folds A-Z only, as the catalogue's case-insensitive comparisons do; of ASCII alone that is all there is to fold, and
    ``lower`` does it many times faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def like(c: Column, query: Column, before: str = "", after: str = "%") -> Column:
    """LIKE with ASCII case folding in which ``%`` and ``_`` of the query are wildcards and a backslash is itself.

    What stands before the query's first wildcard is looked for first, so that few rows come to the pattern.
    """
    folded, q = ascii_lower(c), ascii_lower(query)
    plain = F.regexp_extract(q, "^[^%_]*", 0)
    pattern = F.concat(F.lit(before), F.replace(q, F.lit("\\"), F.lit("\\\\")), F.lit(after))
    return (folded.contains(plain) if before else folded.startswith(plain)) & F.like(folded, pattern)


def with_patterns(queries: DataFrame, column: str) -> DataFrame:
    """``queries`` with _q (folded), _plain (what is before the first wildcard), _starts and _holds (patterns) of a column."""
    q = ascii_lower(F.col(column))
    safe = F.replace(q, F.lit("\\"), F.lit("\\\\"))
    return queries.withColumns({"_q": q, "_plain": F.regexp_extract(q, "^[^%_]*", 0), "_starts": F.concat(safe, F.lit("%")), "_holds": F.concat(F.lit("%"), safe, F.lit("%"))})


def strip_leading_dots(c: Column) -> Column:
    """Drops every leading ``.`` and ``/``, so ``.github/x`` becomes ``github/x``."""
    return F.regexp_replace(c, r"^[./]+", "")


def literal_pattern(query: Column) -> Column:
    """A regular expression that matches the query as it is."""
    return F.regexp_replace(query, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def is_identifier(query: Column) -> Column:
    return query.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def reference_match(content: Column, query: Column, ignore_case: bool = False) -> Column:
    """An identifier must stand between other characters than word characters; anything else just occurs."""
    flag = "(?iu)" if ignore_case else ""
    word = F.concat(F.lit(f"{flag}(?<![A-Za-z0-9_])"), query, F.lit("(?![A-Za-z0-9_])"))
    plain = F.concat(F.lit(flag), literal_pattern(query))
    return F.regexp_like(content, F.when(is_identifier(query), word).otherwise(plain))


def defines(content: Column, query: Column, ignore_case: bool = False) -> Column:
    """A line that declares the query with a keyword, or starts with it and a colon or equals sign."""
    flag, q = "(?iu)" if ignore_case else "", literal_pattern(query)
    keyword = F.concat(F.lit(flag + r"^\s*(?:export\s+)?(?:class|function|def|const|let|var|type|interface)\s+"), q, F.lit("(?![A-Za-z0-9_])"))
    assigned = F.concat(F.lit(flag + r"^\s*"), q, F.lit(r"\s*(?:[:]|=)"))
    return F.regexp_like(content, keyword) | F.regexp_like(content, assigned)


def text_line_score(content: Column, query: Column, test: Column) -> Column:
    """0 definition, 100 starts with, 200 import, 400 contains, else 800; 1000 more in a test file."""
    line, q = F.trim(content), literal_pattern(query)
    base = (
        F.when(F.regexp_like(line, F.concat(F.lit("^"), q, F.lit(r"\b\s*(?:[:]|=)"))), 0)
        .when(F.lower(line).startswith(F.lower(query)), 100)
        .when(F.regexp_like(line, F.concat(F.lit(r"\bimport\b.*\b"), q, F.lit(r"\b"))), 200)
        .when(F.lower(line).contains(F.lower(query)), 400)
        .otherwise(800)
    )
    return base + F.when(test, 1000).otherwise(0)


def occurrences(content: Column, query: Column) -> Column:
    """How often the query occurs in the content, overlapping ones counted, whatever the case.

    Only a query that ends as it starts can overlap itself and needs a search from every place.
    """
    text, q = F.lower(content), F.lower(query)
    border = F.exists(F.when(F.length(q) > 1, F.sequence(F.lit(1), F.length(q) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.right(q, i) == F.left(q, i))
    apart = (F.length(text) - F.length(F.replace(text, q, F.lit("")))) / F.greatest(F.length(q), F.lit(1))
    return F.when(border, F.regexp_count(text, F.concat(F.lit("(?="), literal_pattern(q), F.lit(")")))).otherwise(apart.cast("int"))


def words_of_query(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit("[A-Za-z0-9]+"), F.lit(0))


def identifier_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def query_variants(query: Column) -> Column:
    """The query, and for two words or more its Pascal, camel, snake, kebab and compact forms; at most six, no repeats."""
    words = words_of_query(query)
    title = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    lower = F.transform(words, F.lower)
    camel = F.concat(F.try_element_at(lower, F.lit(1)), F.array_join(F.slice(title, F.lit(2), F.greatest(F.size(title), F.lit(1))), ""))
    forms = F.array(query, F.array_join(title, ""), camel, F.array_join(lower, "_"), F.array_join(lower, "-"), F.array_join(lower, ""))
    return F.when(F.size(words) < 2, F.array(query)).otherwise(F.slice(F.array_distinct(forms), 1, MOST_VARIANTS))


def trimmed_word(w: Column) -> Column:
    """Plural and adverb endings off; the first rule that fits applies."""
    n = F.length(w)
    cut = lambda k: F.left(w, n - k)
    return (
        F.when(w.endswith("ically") & (n > 8), cut(4))
        .when(w.endswith("ly") & (n > 5), cut(2))
        .when(w.rlike("(?:shes|ches|xes|sses)$"), cut(2))
        .when(w.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("s") & ~w.rlike("(?:ss|us)$") & (n > 4), cut(1))
        .otherwise(w)
    )


def query_terms(query: Column) -> Column:
    """At most eight distinct words of a query of two words or more, without stop words; none if fewer than two are left."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z][A-Za-z0-9]*"), F.lit(0)), F.lower)
    words = F.filter(words, lambda w: ~F.array_contains(stop, w) & F.length(w).between(3, 48))
    terms = F.slice(F.array_distinct(F.transform(words, trimmed_word)), 1, MOST_TERMS)
    several = (F.length(query) <= 512) & (F.size(F.filter(F.split(query, r"\s+"), lambda w: w != "")) >= 2)
    return F.when(several & (F.size(terms) >= 2), terms).otherwise(F.array().cast("array<string>"))


def identifier_words(c: Column, keep: bool = True) -> Column:
    """An identifier's words, cut at case and acronym boundaries and underscores; with the identifier before, if it differs."""
    parts = F.replace(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
    return F.when(parts == c, c).otherwise(F.concat_ws(" ", c, parts)) if keep else parts


def redact(c: Column) -> Column:
    """The text without secrets; a pattern is only run over texts that hold a part that any match of it holds.

    What a step gives is the lambda's value for the next: used twice as an expression, it would be evaluated twice a step.
    """
    for (pattern, mark), sign, parts in zip(SECRETS, SIGNS, PARTS, strict=True):
        folded = F.lower if sign.startswith("(?i)") else lambda t: t
        held = lambda t: F.exists(F.array(folded(t)), lambda x: reduce(Column.__or__, [x.contains(p) for p in parts]))  # noqa: B023, E731
        step = lambda t: F.when(held(t), F.regexp_replace(t, pattern, mark)).otherwise(t)  # noqa: B023, E731
        c = F.element_at(F.transform(F.array(c), step), 1)
    return c


ANY_SIGN = re.compile("|".join(f"(?:{s})" if not s.startswith("(?i)") else f"(?i:{s[4:]})" for s in SIGNS))


def redact_text(text: str) -> str:
    if not ANY_SIGN.search(text):
        return text
    for pattern, mark in SECRETS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", mark), text)
    return text


def split_lines(c: Column) -> Column:
    """The text cut at every ``LINE_END``; where only \\n is met, that is looked for as it is, several times faster."""
    return F.when(reduce(Column.__or__, [c.contains(e) for e in OTHER_ENDS]), F.split(c, LINE_END, -1)).otherwise(F.split(c, "\n", -1))


def line_count(c: Column) -> Column:
    r"""Number of \n, and one more if something follows the last; a null text has no lines."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.coalesce(ends + F.when((F.length(c) > 0) & ~c.endswith("\n"), 1).otherwise(0), F.lit(0))


def token_estimate(chars: Column) -> Column:
    return F.floor((chars + 3) / 4).cast("long")
