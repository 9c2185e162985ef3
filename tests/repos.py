"""Small source trees as DataFrames, and the catalogue made of them."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.sources import discovery, extract, lines, resolve
from tessera.sources.shared import stored

SERVICE = {
    "src/app/__init__.py": "",
    "src/app/service.py": "class Service:\n    def run(self):\n        return 1\n",
    "src/app/api.py": "from .service import Service\n\ndef call():\n    return Service().run()\n",
    "tests/test_service.py": "from src.app.service import Service\n\ndef test_run():\n    assert Service().run() == 1\n",
}


def catalog(spark, tree: dict[str, str] | dict[str, dict[str, str]], repo: str = "r"):
    """files, symbols, dependencies, lines and sources of one tree, or of several by repository."""
    trees = tree if tree and isinstance(next(iter(tree.values())), dict) else {repo: tree}
    rows = [(r, p, c, len(c.encode()), 1) for r, t in trees.items() for p, c in t.items()]
    sources = spark.createDataFrame(rows, "repo string, path string, content string, size_bytes long, modified_ns long").where(discovery.wanted(F.col("path")))
    extracted = extract.extract(sources)
    files = lines.file_rows(sources, discovery.LANGUAGES)
    made = {
        "sources": sources, "files": files, "symbols": extract.symbols_of(extracted), "lines": lines.indexed_lines(sources),
        "dependencies": resolve.resolve(extract.imports_of(extracted), files.select("repo", "path"), spark.createDataFrame([(r, p) for r, p, *_ in rows], "repo string, path string")),
    }
    return SimpleNamespace(**{k: stored(v, k) for k, v in made.items()})


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, query string")
