"""Column functions over repository-relative paths with ``/`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a path a test path, by who asks: folder names, and patterns of the file's name.
TEST_RULES: dict[str, tuple[tuple[str, ...], str]] = {
    "catalog": (("tests",), r"^test_|\.test\.|_test\.py$"),
    "lookup": (("test", "tests", "testing", "__tests__"), r"^test_|\.test\.|_test\.py$"),
    "context": (("test", "tests", "testing", "__tests__"), r"^test_|\.test\.|\.spec\.|_test\.py$"),
    "related": (("test", "tests", "__tests__"), r"^test_|\.(?:test|spec)\.(?:js|jsx|ts|tsx)$"),
    "risk": (("test", "tests", "__tests__"), r"^test_|\.test\.|\.spec\."),
    "benchmark": (("test", "tests", "__tests__"), r"^test_|\.test\.|_test\.py$"),
}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot starts no suffix."""
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def is_test(path: Column, flavor: str = "catalog") -> Column:
    """Whether a path is a test's. The callers' rules differ (see ``TEST_RULES``); ``documents`` is that of ranked documents."""
    if flavor == "documents":  # here a folder called test_… counts as well, and .test. anywhere
        return path.rlike(r"(?:^|/)(?:tests/|testing/|__tests__/|test/|test_)|\.test\.|_test\.py$")
    if flavor == "benchmark":
        path = F.regexp_replace(path, "^[^/:]*:", "")
    folders, name = TEST_RULES[flavor]
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders))) | basename(path).rlike(name)


def label(root: Column) -> Column:
    """A repository's label: its folder's name, with the parent's before it where that is ``src``."""
    parts = F.filter(F.split(root, "/"), lambda p: p != "")
    last, parent = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return F.when((last == "src") & parent.isNotNull(), F.concat_ws("/", parent, last)).otherwise(F.coalesce(last, F.lit("")))


def ancestors(path: Column, depth: Column) -> Column:
    """The folders above a path, from the top, down to ``depth`` levels."""
    parts = F.split(path, "/")
    levels = F.least(F.size(parts) - 1, depth)
    return F.when(levels < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), levels), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


def below(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies under it; the empty prefix holds all."""
    prefix = prefix.strip().strip("/")
    return F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")
