"""Finding source files: what a version control system lists, or what lies in a folder, less what is never indexed.

Repositories are rows: each is listed by one task, which tries git and then walks the folder, and its files are read by
other tasks, dealt by size. Spark's own readers leave out names that start with an underscore or a dot, so folders are
listed and files are read through Arrow's file systems. A folder must be one that every executor reaches.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are skipped wherever they are.
SKIPPED = (
    ".tessera .git .hg .mypy_cache .pytest_cache .ruff_cache .tox .venv .agents .claude __pycache__ build coverage dist node_modules target venv .worktree .worktrees"
).split()
#: Languages by suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".css": "css"}
#: Paths whose content is secret as a whole: environment files, keys, credential stores.
SECRET = r"(?i)(?:^|/)(?:\.env(?:\..*)?|\.(?:ssh|gnupg|aws|kube|docker)/.*|\.netrc|\.npmrc|\.pypirc|id_(?:rsa|dsa|ecdsa|ed25519)[^/]*|[^/]*\.(?:pem|key|p12|pfx|keystore|jks)|(?:credentials|secrets?)(?:\.[^/]*)?)$"
GIT_SECONDS = 10
#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20
LISTED = "repo string, root string, path string, size_bytes long, modified_ns long, error string"


def is_secret(path: Column) -> Column:
    return path.rlike(SECRET)


def wanted(path: Column, suffixes: Iterable[str] | None = None) -> Column:
    """Whether a relative path is a source: a known suffix, no skipped folder, no secret."""
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return suffix.isin(*(suffixes or LANGUAGES)) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED))) & ~is_secret(path)


def glob_pattern(glob: str) -> str:
    """A file-name pattern as a regular expression; ``*`` and ``?`` match slashes too."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", r"\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def ignore_rule(lines: Iterable[str]) -> Callable[[str], bool]:
    """Whether a relative path is ignored by a file of patterns: by its path, its name or, without a slash, a part of it."""
    patterns = [p for p in (line.strip().rstrip("/") for line in lines) if p and not p.startswith("#")]
    either = re.compile("|".join(f"(?:{glob_pattern(p).removeprefix('(?s)')})" for p in patterns) or r"(?!)", re.S)
    parts = {p for p in patterns if "/" not in p}
    return lambda path: bool(either.match(path) or either.match(path.rpartition("/")[2]) or parts.intersection(path.split("/")))


@cache
def opened(root: str):
    """A file system of Arrow's and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match("[a-z0-9]+:/", root) else (fs.LocalFileSystem(), os.path.abspath(root))


def walked(root: str) -> Iterator[tuple[str, int, int]]:
    """path, size and time of the regular files below a folder, less skipped folders and what its ``.gitignore`` names."""
    from pyarrow import fs

    store, base = opened(root)
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no such folder: {root}")
    rules, at = [], f"{base}/.gitignore"
    if store.get_file_info(at).type == fs.FileType.File:
        rules = store.open_input_stream(at).read().decode("utf-8", "replace").splitlines()
    ignored = ignore_rule(rules)
    folders = [base]
    while folders:
        for info in store.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
            path = info.path[len(base) :].lstrip("/")
            if info.type == fs.FileType.Directory and info.base_name not in SKIPPED:
                folders.append(info.path)
            elif info.type == fs.FileType.File and not ignored(path):
                yield path, info.size, info.mtime_ns


def git(root: str, *arguments: str) -> str | None:
    """What git says in a local folder; None where it can't say."""
    if not root.startswith(("/", "file:")):
        return None
    try:
        return subprocess.run(["git", *arguments], cwd=re.sub("^file:/*", "/", root), check=True, capture_output=True, text=True, timeout=GIT_SECONDS).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def tracked(root: str) -> Iterator[tuple[str, int, int]] | None:
    """path, size and time of the regular files that git lists in a local folder, tracked or not ignored; None without git."""
    out = git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z", "--", ".")
    if out is None:
        return None
    from pyarrow import fs

    store, base = opened(root)
    paths = sorted({p for p in out.split("\0") if p})
    found = zip(paths, store.get_file_info([f"{base}/{p}" for p in paths]), strict=True)
    return ((p, i.size, i.mtime_ns) for p, i in found if i.type == fs.FileType.File)


def repositories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """repo, root of the repositories named."""
    return spark.createDataFrame(sorted(roots.items()), "repo string, root string")


def listing(repos: DataFrame, suffixes: Iterable[str] | None = None, use_git: bool = True) -> DataFrame:
    """repo, root, path, size_bytes, modified_ns, error of the sources of each repository (repo, root).

    A repository that can't be listed gives one row of an error and no path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTED.split(", ")]
        for batch in batches:
            for repo, root in zip(batch["repo"], batch["root"], strict=True):
                try:
                    found = (tracked(root) if use_git else None) or walked(root)
                    rows = [(repo, root, p, size, time, None) for p, size, time in found]
                except Exception as e:  # any trouble of one repository is that repository's row
                    rows = [(repo, root, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"size_bytes": "Int64", "modified_ns": "Int64"})

    spark = repos.sparkSession
    each = repos.select("repo", "root").repartition(max(1, min(repos.count(), spark.sparkContext.defaultParallelism * 4)), "repo")
    rows = each.mapInPandas(run, LISTED)
    return rows.where(F.col("error").isNotNull() | wanted(F.col("path"), suffixes))


def contents(files: DataFrame) -> DataFrame:
    """``files`` (repo, root, path, size_bytes, …) with content, the text; a file that is gone meanwhile has a null."""
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64].copy()
                texts = []
                for root, path in zip(part["root"], part["path"], strict=True):
                    store, base = opened(root)
                    try:
                        texts.append(store.open_input_stream(f"{base}/{path}").read().decode("utf-8", "replace"))
                    except OSError:
                        texts.append(None)
                yield part.assign(content=texts)[[*names, "content"]]

    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    dealt = files.repartition(max(1, -(-total // TASK_BYTES)), "repo", "path")
    return dealt.mapInPandas(run, files.schema.add("content", "string"))


def sources(repos: DataFrame, suffixes: Iterable[str] | None = None, use_git: bool = True) -> DataFrame:
    """repo, path, content, size_bytes, modified_ns of the sources of each repository (repo, root)."""
    found = listing(repos, suffixes, use_git).where("error IS NULL").drop("error")
    return contents(found).select("repo", "path", "content", "size_bytes", "modified_ns")


def walk(spark: SparkSession, repo: str, root: str, suffixes: Iterable[str] | None = None) -> DataFrame:
    """``sources`` of one folder, whatever git says of it."""
    return sources(repositories(spark, {repo: root}), suffixes, use_git=False)


def discover(spark: SparkSession, repo: str, root: str, suffixes: Iterable[str] | None = None) -> DataFrame:
    """``sources`` of one repository: those that git lists, or else those that a walk finds."""
    return sources(repositories(spark, {repo: root}), suffixes)


def git_state(repos: DataFrame) -> DataFrame:
    """repo, git_head, git_status: the commit, and a digest of what differs from it in the sources; empty without git.

    Equal digests mean that no listed file changed: the digest holds git's list of changes, the size and time of the
    files in it, and the ignore files from the folder up.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(repo, (git(root, "rev-parse", "HEAD") or "").strip(), status_digest(root)) for repo, root in zip(batch["repo"], batch["root"], strict=True)]
            yield pd.DataFrame(rows, columns=["repo", "git_head", "git_status"])

    return repos.select("repo", "root").mapInPandas(run, "repo string, git_head string, git_status string")


def status_digest(root: str) -> str:
    out = git(root, "status", "--porcelain=v1", "--untracked-files=all", "-z", "--", ".", f":(exclude){SKIPPED[0]}")
    top = git(root, "rev-parse", "--show-toplevel")
    if out is None or top is None:
        return ""
    told = hashlib.sha256(out.encode())
    folder, top = os.path.realpath(re.sub("^file:/*", "/", root)), os.path.realpath(top.strip())
    above = [folder]
    while above[-1] != top and above[-1] != "/":
        above.append(os.path.dirname(above[-1]))
    changed = [os.path.join(top, entry[3:] if entry[2:3] == " " else entry) for entry in out.split("\0") if entry]
    for path in [*(f"{a}/.gitignore" for a in above), *changed]:
        try:
            info = os.stat(path)
            told.update(f"{path}\0{info.st_size}\0{info.st_mtime_ns}\n".encode())
        except OSError:
            told.update(f"{path}\0gone\n".encode())
    return told.hexdigest()
