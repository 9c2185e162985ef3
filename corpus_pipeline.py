"""A corpus pipeline of five stages: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, whatever else they hold, in the same order.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, ngram_join, pii, quality
from tessera.llm.common import stored, table

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, as often as they stand; null, empty and short texts go, whatever their other columns.

    Rows without id are judged by their text and are never trusted. An llr of exactly the threshold is kept. Columns keep
    their names, nulls and order, whatever they are called; an empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*("text" if c == "text" else "doc_id" if c == "doc_id" else f"c{i}" for i, c in enumerate(names)))
    counts = quality.gram_counts(plain, quality.all_trusted(table(spark, sf_dir, "labels")))
    judged = quality.judge(plain, quality.log_ratios(counts), keep=tuple(plain.columns))
    return judged.where("kept").select(*(F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the row of least id, nulls last, then of least text hash; rows without words stay.

    Rows are judged one by one: of rows that share an id each stays or goes with its own text, and rows that are equal in
    id and text are one. Repeated columns of other names are kept as they are; an empty table gives an empty one.
    """
    names = docs.columns
    plain = docs.toDF(*(c if c in ("text", "doc_id") else f"c{i}" for i, c in enumerate(names)))
    return ngram_join.one_of_each(plain).toDF(*names)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, as often as they stand, with confirmed personal data replaced by its kind in brackets.

    Null and empty texts stay as they are, and so do ids and other columns but n_chars, the new text's length. A text's
    length isn't bounded; an empty table gives an empty one.
    """
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times; rows without words are never taken.

    A null source is a source. Equal rows may be taken a different number of times, one apart, so that sums come near the
    targets; null ids are ids of their own value. Columns keep their names and nulls; an empty table gives an empty one.
    """
    mixed = mixing.mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), keep=("row",))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of ids and decoded text, for each row.

    Rows return as often as they stand, null ids as they are; a null text is encoded as an empty one, of no tokens. Other
    columns are ignored; a text's length isn't bounded; an empty table gives an empty one.
    """
    path = public_tokenizers.path(VOCABULARY)
    return bpe.bpe_round_trip(docs, path, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing_to_weights", mixing_to_weights),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't say what hashed likelihoods, similarity components and merge rounds give; a test holds run()'s rows against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
