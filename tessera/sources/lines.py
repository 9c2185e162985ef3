"""Sources as indexed lines, and what is known of a file from its text alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def indexed_lines(sources: DataFrame) -> DataFrame:
    """repo, path, line (from 1), content: lines of the redacted text that hold more than white space.

    Whole texts are redacted before they are cut, since some secrets span lines. A null content has no lines.
    """
    # What follows a final line end is an empty text, which is no line.
    lines = sources.select("repo", "path", F.posexplode(F.element_at(F.transform(F.array(text.redact(F.col("content"))), text.split_lines), 1)).alias("pos", "content"))
    return lines.select("repo", "path", (F.col("pos") + 1).cast("long").alias("line"), "content").where(F.col("content").rlike(r"\S"))


#: Lines of a bin, by which spans and lines of a file meet.
BIN = 64


def binned(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """``rows`` with _bin, once for each bin of lines that its span (start to end) touches; a span that ends before it starts has none."""
    low, high = F.floor(start / BIN), F.floor(end / BIN)
    return rows.withColumn("_bin", F.explode_outer(F.when(high >= low, F.sequence(low, high))))


def meet(spans: DataFrame, places: DataFrame, start: Column, end: Column, at: str, how: str = "inner") -> DataFrame:
    """``spans`` (repo, path and others) joined to ``places`` (_r, _p and others) whose line ``at`` is in the span.

    They meet by bins of a file, so a file's spans and lines are never all put together.
    """
    left, right = binned(spans, start, end), places.withColumn("_at_bin", F.floor(F.col(at) / BIN))
    same = (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("_bin") == F.col("_at_bin"))
    return left.join(right, same & F.col(at).between(start, end), how).drop("_bin", "_at_bin")


def file_rows(sources: DataFrame, language: dict[str, str]) -> DataFrame:
    """repo, path, language, line_count, size_bytes, content_hash, modified_ns of sources (repo, path, content, size, time)."""
    names = F.create_map(*[F.lit(x) for pair in language.items() for x in pair])
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return sources.select(
        "repo", "path", F.coalesce(F.try_element_at(names, suffix), F.lit("text")).alias("language"), text.line_count(F.col("content")).cast("long").alias("line_count"),
        F.coalesce("size_bytes", F.octet_length("content")).cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"), F.col("modified_ns").cast("long").alias("modified_ns"),
    )


def content_slice(sources: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """repo, path, start_line, end_line, content of one file's redacted lines, blank ones included."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("start must be at least 1 and end at least start")
    lines = F.split(F.regexp_replace(text.redact(F.col("content")), f"(?:{text.LINE_END})\\z", ""), text.LINE_END, -1)
    last = F.least(F.lit(end), F.size("lines")) if end is not None else F.size("lines")
    cut = F.when(last >= start, F.slice("lines", F.lit(start), last - start + 1)).otherwise(F.array().cast("array<string>"))
    return sources.where(F.col("path") == path).withColumn("lines", lines).select("repo", "path", F.lit(start).alias("start_line"), last.cast("int").alias("end_line"), F.array_join(cut, "\n").alias("content"))
