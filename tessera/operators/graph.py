"""Dependency graphs: who depends on a file, directly or not, how far a change reaches, and which tests go with it."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.sources.shared import stored

#: Stems that many files share, and path parts that say nothing about where a file belongs.
GENERIC = "__init__ client config constants endpoints errors models types utils".split()
PLAIN_PARTS = "__tests__ src test tests unit".split()
MENTIONED = 50
#: Bytes of bodies that one task takes, and of names in one automaton.
BODY_BYTES, NAME_BYTES = 16 << 20, 4 << 20
#: Bits of all sets of files that a task holds at once while it counts what files lead to.
MASK_BITS = 1 << 29


def internal_edges(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """repo, source_path, target_path: distinct resolved edges to files that are known."""
    edges = dependencies.where("resolved").select("repo", "source_path", "target_path").distinct()
    return edges.join(files.select("repo", F.col("path").alias("target_path")), ["repo", "target_path"], "left_semi")


def direct_dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, target, path: the files that depend on each target (repo, target)."""
    return edges.join(targets, (edges["repo"] == targets["repo"]) & (edges["target_path"] == targets["target"])).select(edges["repo"], "target", F.col("source_path").alias("path"))


#: Breadth-first rounds for a part of all targets before distances are doubled.
SHALLOW = 16


def dependents(edges: DataFrame, targets: DataFrame, most_rounds: int = 40) -> DataFrame:
    """repo, target, path, depth: all files that depend on a target, 1 for direct ones; a target isn't its own unless directly.

    Files are numbered, and distances double: what is at most k away is known for all files, and what is at most 2 k away
    goes over a file that is exactly k away. So a chain of n files takes log2(n) rounds, each a join of numbers and a table
    in the shared folder. For few of all targets the first rounds go breadth-first from these alone, which mostly ends it.
    """
    edges = edges.select("repo", "source_path", "target_path").distinct()
    ends = edges.select("repo", F.col("source_path").alias("path")).union(edges.select("repo", F.col("target_path").alias("path"))).distinct()
    names = stored(ends.withColumn("id", F.monotonically_increasing_id()), "names")
    of = lambda column, to: names.select("repo", F.col("path").alias(column), F.col("id").alias(to))
    near = stored(edges.join(of("source_path", "s"), ["repo", "source_path"]).join(of("target_path", "t"), ["repo", "target_path"]).select("t", "s", F.lit(1).cast("long").alias("depth")), "edges")
    wanted = stored(targets.select("repo", F.col("target").alias("path")).distinct().join(names, ["repo", "path"]).select(F.col("id").alias("t")), "targets")
    some = 4 * wanted.count() < names.count()
    found = breadth_first(near, wanted) if some else None
    if found is None:
        found = doubled(near, most_rounds).join(wanted, "t", "left_semi")
    path = lambda key, name: names.select(F.col("id").alias(key), F.col("path").alias(name))
    return found.join(names.select(F.col("id").alias("t"), "repo", F.col("path").alias("target")), "t").join(path("s", "path"), "s").select("repo", "target", "path", "depth")


def breadth_first(near: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """t, s, depth for the wanted t, or nothing if there is more after ``SHALLOW`` rounds."""
    step = near.select(F.col("t").alias("m"), F.col("s").alias("s2"))
    seen = frontier = stored(near.join(wanted, "t", "left_semi"), "reached")
    for depth in range(2, SHALLOW + 2):
        new = frontier.join(step, F.col("s") == F.col("m")).select("t", F.col("s2").alias("s")).where("t <> s").distinct()
        frontier = stored(new.join(seen, ["t", "s"], "left_anti").withColumn("depth", F.lit(depth).cast("long")), "reached")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    return None


def doubled(near: DataFrame, most_rounds: int) -> DataFrame:
    """t, s, depth of all pairs of which s leads to t, by the shortest way."""
    known = last = near
    reach = 1
    for _ in range(most_rounds):
        far = last.where((F.col("depth") == reach) & (F.col("t") != F.col("s"))).select("t", F.col("s").alias("m"))
        on = known.where("t <> s").select(F.col("t").alias("m"), "s", "depth")
        new = far.join(on, "m").where("t <> s").groupBy("t", "s").agg((F.min("depth") + reach).alias("depth"))
        last = stored(new.join(known, ["t", "s"], "left_anti"), "reached")
        if last.isEmpty():
            return known
        known, reach = known.unionByName(last), 2 * reach
    raise RuntimeError(f"paths of more than 2 ** {most_rounds} edges")


def components_first(near: list[list[int]]) -> list[list[int]]:
    """Strongly connected components of a graph, each after those that it leads to (Tarjan's, with a stack of its own)."""
    order, low, out, path, on = [-1] * len(near), [0] * len(near), [], [], [False] * len(near)
    n = 0
    for root in range(len(near)):
        if order[root] >= 0:
            continue
        work = [(root, iter(near[root]))]
        order[root] = low[root] = n
        n += 1
        path.append(root)
        on[root] = True
        while work:
            node, rest = work[-1]
            for other in rest:
                if order[other] < 0:
                    order[other] = low[other] = n
                    n += 1
                    path.append(other)
                    on[other] = True
                    work.append((other, iter(near[other])))
                    break
                if on[other]:
                    low[node] = min(low[node], order[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(path.pop())
                        on[part[-1]] = False
                    out.append(part)
    return out


def reach(near: list[list[int]], bits: int = MASK_BITS, least: int = 1024) -> list[tuple[int, int]]:
    """For each node how many it leads to directly, and how many more further on, itself not counted there.

    Cycles are one; sets are bit masks of a range of nodes at a time, so that all of them take about ``bits`` bits.
    """
    parts = components_first(near)
    of = [0] * len(near)
    for i, part in enumerate(parts):
        for node in part:
            of[node] = i
    step = max(least, bits // max(1, len(parts)))
    total = [0] * len(near)
    for first in range(0, len(near), step):
        masks: list[int] = []
        for part in parts:
            mask = 0
            for node in part:
                for other in near[node]:
                    if first <= other < first + step:
                        mask |= 1 << (other - first)
                    if of[other] < len(masks):
                        mask |= masks[of[other]]
            masks.append(mask)
            for node in part:
                own = first <= node < first + step and mask >> (node - first) & 1
                total[node] += mask.bit_count() - int(own)
    return [(len(o), t - len(o) + (node in o)) for node, (o, t) in enumerate(zip(near, total, strict=True))]


def reach_counts(edges: DataFrame) -> DataFrame:
    """repo, target, direct, transitive: how many files depend on each target, of which ``dependents`` has the rows.

    A repository's edges (distinct) are one group: files of one repository are a bounded number, pairs of them aren't
    written anywhere.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([part["source_path"], part["target_path"]]))
        near: list[list[int]] = [[] for _ in names]
        for source, target in zip(codes[: len(part)].tolist(), codes[len(part) :].tolist(), strict=True):
            near[target].append(source)
        counts = reach(near)
        return pd.DataFrame({"repo": part["repo"].iloc[0], "target": names, "direct": [d for d, _ in counts], "transitive": [t for _, t in counts]})

    return edges.select("repo", "source_path", "target_path").distinct().groupBy("repo").applyInPandas(run, "repo string, target string, direct long, transitive long")


def blast(direct: Column, transitive: Column, tests: Column) -> Column:
    return 2.0 * direct + transitive + 0.5 * tests


def blast_label(score: Column) -> Column:
    return F.when(score >= 30, "critical").when(score >= 15, "high").when(score >= 5, "medium").otherwise("low")


def context_parts(path: Column) -> Column:
    """The parts of a path, its suffix off, that tell where the file belongs."""
    whole = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    kept = F.filter(F.split(whole, "/"), lambda p: ~p.isin(*PLAIN_PARTS) & ~p.isin(*GENERIC))
    return F.array_distinct(F.filter(F.transform(kept, lambda p: F.regexp_replace(p, "^test_", "")), lambda p: p != ""))


def test_stem(path: Column) -> Column:
    """What a test's file name says that it tests."""
    name = F.regexp_replace(paths.basename(path), "^test_", "")
    name = F.regexp_replace(name, r"\.(?:test|spec)\.(?:js|jsx|ts|tsx)$", "")
    return F.regexp_replace(name, r"\.[^.]*$", "")


def related_tests(files: DataFrame, dependencies: DataFrame, symbols: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, target, path, reason: tests that name, import or mention a target (repo, target), reasons sorted and joined.

    A name counts for a stem that many files share only if the paths have another part in common. Mentions are any of
    the target's first 50 public symbols anywhere in the test's text (``sources``: repo, path, content).
    """
    tests = files.select("repo", "path").where(paths.is_test(F.col("path"), "related"))
    t = targets.select("repo", "target", paths.stem(paths.basename(F.col("target"))).alias("stem")).distinct()
    named = tests.withColumn("_s", test_stem(F.col("path")))
    named = named.withColumn("stem", F.explode(F.array_distinct(F.array("_s", F.regexp_replace("_s", "^test_", ""))))).join(t, ["repo", "stem"])
    near = ~F.col("stem").isin(*GENERIC) | F.arrays_overlap(context_parts(F.col("target")), context_parts(F.col("path")))
    by_name = named.where(near).select("repo", "target", "path", F.lit("name matches source file").alias("reason"))
    edges = dependencies.select("repo", F.col("source_path").alias("path"), F.col("target_path").alias("target"))
    by_import = edges.join(t.select("repo", "target"), ["repo", "target"], "left_semi").join(tests, ["repo", "path"], "left_semi").select("repo", "target", "path", F.lit("imports source file").alias("reason"))
    first = Window.partitionBy("repo", "path").orderBy("line", "name", "symbol_id")
    public = symbols.where("name <> '' AND NOT startswith(name, '_')").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MENTIONED)
    names = public.select("repo", F.col("path").alias("target"), "name").join(t.select("repo", "target"), ["repo", "target"], "left_semi").distinct()
    bodies = sources.join(tests, ["repo", "path"], "left_semi").select("repo", "path", "content")
    by_mention = mentions(bodies, names.select("repo", "name")).join(names, ["repo", "name"]).select("repo", "target", "path", F.lit("mentions source symbol").alias("reason"))
    reasons = by_name.unionByName(by_import).unionByName(by_mention).groupBy("repo", "target", "path")
    return reasons.agg(F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reason"))


def mentions(bodies: DataFrame, names: DataFrame, body_bytes: int = BODY_BYTES, name_bytes: int = NAME_BYTES) -> DataFrame:
    """repo, path, name: which of a repository's ``names`` (repo, name) stand anywhere in which ``bodies`` (repo, path, content).

    A repository's names are dealt to blocks of bounded size and its bodies to lanes; each block is an automaton that runs
    over a lane's bodies once, so work grows with text and matches, not with bodies times names.
    """
    pieces = lambda c, most: F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length(c) + 16) / most))
    names, keys = names.distinct(), ["repo", "block", "lane"]
    sizes = bodies.groupBy("repo").agg(pieces("content", body_bytes).alias("lanes")).join(names.groupBy("repo").agg(pieces("name", name_bytes).alias("blocks")), "repo")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    looked_for = names.join(sizes, "repo").select("repo", F.pmod(F.xxhash64("name"), "blocks").alias("block"), up_to("lanes").alias("lane"), "name")
    looked_in = bodies.join(sizes, "repo").select("repo", up_to("blocks").alias("block"), F.pmod(F.xxhash64("path"), "lanes").alias("lane"), "path", "content")

    def run(block: pa.Table, lane: pa.Table) -> pa.Table:
        import ahocorasick

        automaton, out = ahocorasick.Automaton(), []
        for name in block["name"].to_pylist():
            automaton.add_word(name, name)
        if len(automaton) and lane.num_rows:
            automaton.make_automaton()
            repo = block["repo"][0].as_py()
            for path, content in zip(lane["path"].to_pylist(), lane["content"], strict=True):
                out += [(repo, path, name) for name in {name for _, name in automaton.iter(content.as_py() or "")}]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, pa.string()) for c in columns], ["repo", "path", "name"])

    return looked_for.groupBy(*keys).cogroup(looked_in.groupBy(*keys)).applyInArrow(run, "repo string, path string, name string")


def change_report(reached: DataFrame, tests: DataFrame, targets: DataFrame) -> DataFrame:
    """repo, target, direct, transitive, tests, score, label of the rows of ``dependents`` and ``related_tests``."""
    counts = reached.groupBy("repo", "target").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    return scored(counts, tests, targets)


def scored(counts: DataFrame, tests: DataFrame, targets: DataFrame) -> DataFrame:
    n = tests.groupBy("repo", "target").agg(F.count("*").alias("tests"))
    rows = targets.join(counts, ["repo", "target"], "left").join(n, ["repo", "target"], "left").na.fill(0, ["direct", "transitive", "tests"])
    score = blast(F.col("direct"), F.col("transitive"), F.col("tests"))
    return rows.select("repo", "target", "direct", "transitive", "tests", score.alias("score"), blast_label(score).alias("label"))


def risk(files: DataFrame, dependencies: DataFrame, symbols: DataFrame, sources: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` files of each repository that a change of reaches furthest, tests left out, by score, lines and path."""
    targets = files.where(~paths.is_test(F.col("path"), "risk")).select("repo", F.col("path").alias("target"))
    counts = reach_counts(internal_edges(dependencies, files))
    rows = scored(counts, related_tests(files, dependencies, symbols, sources, targets), targets)
    rows = rows.join(files.select("repo", F.col("path").alias("target"), "line_count"), ["repo", "target"])
    w = Window.partitionBy("repo").orderBy(F.desc("score"), F.desc("line_count"), "target")
    return rows.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= limit)


def unresolved_sources(dependencies: DataFrame) -> DataFrame:
    """repo, path: files with a dependency that may resolve once files are added."""
    return dependencies.where("NOT resolved AND category = 'unresolved'").select("repo", F.col("source_path").alias("path")).distinct()


def to_reanalyse(dependencies: DataFrame, removed: DataFrame, added: DataFrame, current: DataFrame) -> DataFrame:
    """repo, path of current files to read again: dependents of removed files and, where files were added, unresolved ones."""
    gone = removed.select("repo", F.col("path").alias("target_path"))
    affected = dependencies.join(gone, ["repo", "target_path"], "left_semi").select("repo", F.col("source_path").alias("path"))
    waiting = unresolved_sources(dependencies).join(added.select("repo").distinct(), "repo", "left_semi")
    return affected.union(waiting).distinct().join(current.select("repo", "path"), ["repo", "path"], "left_semi")
