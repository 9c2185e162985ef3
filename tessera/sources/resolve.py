"""Imports resolved to files: candidates in order, joined to the paths that exist, the first that does wins."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes tried for scripts, and suffixes of files that are assets.
SCRIPTS = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".css")
ASSETS = ".avif .bmp .eot .gif .ico .jpeg .jpg .json .mp4 .png .svg .ttf .webm .webp .woff .woff2".split()


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def normal(path: Column) -> Column:
    """A path without ``.`` and with ``..`` taken back; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when((F.size(a) == 0) | a.isNull(), F.lit(None).cast("array<string>")).otherwise(up(a))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def python_candidates(path: Column, name: Column) -> Column:
    """Modules a dotted name may be: relative ones from the file's folder up, absolute ones at the root, below src, below the folder."""
    level = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.replace(F.expr("substr(name, length(regexp_extract(name, '^([.]*)', 1)) + 1)"), F.lit("."), F.lit("/"))
    parts = F.split(folder(path), "/")
    depth = F.when(folder(path) == "", 0).otherwise(F.size(parts))
    keep = depth - (level - 1)
    base = F.when(keep < 0, F.lit(None).cast("string")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), "/"))
    joined = F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest))
    relative = F.when(base.isNull(), F.array().cast("array<string>")).when(joined == "", F.array(F.lit("__init__.py"))).otherwise(F.array(F.concat(joined, F.lit(".py")), F.concat(joined, F.lit("/__init__.py"))))
    plain = F.array_join(F.filter(F.split(name, r"\."), lambda p: p != ""), "/")
    absolute = F.array(*[F.concat(F.lit(a), plain, F.lit(b)) for a in ("", "src/") for b in (".py", "/__init__.py")])
    near = F.when(folder(path) != "", F.transform(absolute, lambda c: F.concat(folder(path), F.lit("/"), c))).otherwise(F.array().cast("array<string>"))
    return F.when(level > 0, relative).otherwise(F.concat(absolute, near))


def script_target(path: Column, name: Column) -> Column:
    """The path that a script's import names, without its query; null for packages and paths outside."""
    plain = F.regexp_replace(name, r"[?#].*$", "")
    at = F.when(plain.startswith("/"), plain).when(plain.startswith("."), F.concat_ws("/", F.when(folder(path) != "", folder(path)), plain))
    return F.when(at.isNotNull(), normal(at))


def script_candidates(target: Column) -> Column:
    bare = F.regexp_extract(target, r"[^/](\.[^./]+)$", 1) == ""
    each = lambda before: F.array(*[F.concat(target, F.lit(before + s)) for s in SCRIPTS])
    all_ = F.concat(F.array(target), F.when(bare, each("")).otherwise(F.array().cast("array<string>")), each("/index"))
    return F.when(target.isNull(), F.array().cast("array<string>")).otherwise(all_)


def resolve(imports: DataFrame, files: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """repo, source_path, target_path, import_name, kind, resolved, category of imports (repo, path, ordinal, name, kind).

    ``files`` (repo, path) are the sources known; ``assets`` (repo, path) all files there are, among which a script's
    import may be an asset. The joins are by repository and path, and nothing is sent to every task: tables of paths are
    compressed well, so Spark would take them for small and build them in the driver.
    """
    script = F.col("path").rlike(r"\.(?:js|mjs|cjs|jsx|ts|tsx)$")
    rows = imports.withColumns({"script": script, "target": F.when(script, script_target(F.col("path"), F.col("name")))})
    rows = rows.withColumn("candidates", F.when(F.col("script"), script_candidates(F.col("target"))).otherwise(python_candidates(F.col("path"), F.col("name"))))
    keys = ["repo", "path", "ordinal"]
    tried = rows.select(*keys, F.posexplode("candidates").alias("place", "candidate"))
    known = files.select("repo", F.col("path").alias("candidate")).distinct()
    hit = tried.join(known.hint("merge"), ["repo", "candidate"]).groupBy(*keys).agg(F.min_by("candidate", "place").alias("found"))
    rows = rows.join(hit.hint("merge"), keys, "left")
    if assets is not None:
        there = assets.select("repo", F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
        suffix = F.lower(F.regexp_extract("target", r"[^/](\.[^./]+)$", 1))
        rows = rows.join(there.hint("merge"), ["repo", "target"], "left").withColumn("asset", F.when(F.col("there") & suffix.isin(*ASSETS), F.col("target")))
    else:
        rows = rows.withColumn("asset", F.lit(None).cast("string"))
    name = F.col("name")
    outside = name.startswith(".") | (F.col("script") & name.startswith("/"))
    root = F.split(F.regexp_replace(name, r"^\.+", ""), r"\.")[0]
    package = F.when(name.startswith("@"), F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, "/", 1))
    unknown = F.when(F.col("script"), F.when(outside, F.regexp_replace(name, r"[?#].*$", "")).otherwise(package)).otherwise(F.when(root == "", name).otherwise(root))
    library = ~F.col("script") & root.isin(*sorted(sys.stdlib_module_names))
    category = F.when(F.col("found").isNotNull(), "code").when(F.col("asset").isNotNull(), "asset").when(outside, "unresolved").when(library, "stdlib").otherwise("external")
    return rows.select("repo", F.col("path").alias("source_path"), F.coalesce("found", "asset", unknown).alias("target_path"), name.alias("import_name"), "kind", F.col("found").isNotNull().alias("resolved"), category.alias("category"))
