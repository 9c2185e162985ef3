"""Symbol search through one provider or another: the catalogue, or an index that another tool has made of a repository."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources import events

CATALOG, FOREIGN = "catalog", "foreign"
PROVIDERS = (CATALOG, FOREIGN)
VARIABLE = "TESSERA_SYMBOL_PROVIDER"
FOUND = ("query_id", "repo", "name", "qualified_name", "kind", "path", "line", "end_line", "signature", "summary", "provider", "position")


def default_provider() -> str:
    """What the environment names, or the catalogue if that is unset or no provider."""
    named = os.environ.get(VARIABLE, "").strip().lower()
    return named if named in PROVIDERS else CATALOG


def providers_of(text: str | None) -> list[str]:
    """The providers in a list with commas, once each; all of them if there is none."""
    named = [p.strip().lower() for p in (text or "").split(",")]
    return list(dict.fromkeys(p for p in named if p in PROVIDERS)) or list(PROVIDERS)


def find(queries: DataFrame, symbols: DataFrame, foreign: DataFrame | None = None, provider: str | None = None, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """The columns ``FOUND`` for each query (query_id, query) by a provider (None: the default); an unknown one is an error.

    ``foreign`` are the symbols of other tools' indexes with the repository that each is of (``events.foreign_sources``);
    a repository without one finds nothing there.
    """
    provider = default_provider() if provider is None else provider
    if provider == CATALOG:
        rows = search.provider_rows(search.symbol_search(symbols, queries, limit, fuzzy))
        return rows.select(*(F.col(c).cast("long").alias(c) if c in ("line", "end_line") else c for c in FOUND))
    if provider != FOREIGN:
        raise ValueError(f"unknown provider {provider}")
    if foreign is None:
        raise ValueError("no foreign index")
    rows = events.foreign_symbols(foreign, queries, limit)
    return rows.select(
        "query_id", "repo", "name", F.coalesce("qualified_name", "name").alias("qualified_name"), "kind", F.col("file").alias("path"), F.col("line").cast("long").alias("line"), F.lit(None).cast("long").alias("end_line"),
        "signature", "summary", F.lit(FOREIGN).alias("provider"), "position",
    )
