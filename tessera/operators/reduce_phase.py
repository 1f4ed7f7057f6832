"""Whole-corpus rules as DataFrame programs over facts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.imports import resolved
from tessera.operators.tables import checkpointed

if TYPE_CHECKING:
    import pandas as pd


def unused_exports(exports: DataFrame, imports: DataFrame, wildcards: DataFrame, files: DataFrame, entry_points: list[str] | None = None) -> DataFrame:
    """exports (file, symbol, line, column) that nothing imports.

    imports: (file, specifier, symbol); wildcards: (file, specifier), which use all of their target.
    Two anti-joins; both used sets are distinct before they are joined.
    """
    used = resolved(imports, files).select(F.col("target").alias("file"), "symbol").distinct()
    whole = resolved(wildcards, files).select(F.col("target").alias("file")).distinct()
    left = exports.filter(~F.col("file").isin(*entry_points)) if entry_points else exports
    left = left.join(whole, "file", "left_anti").join(used, ["file", "symbol"], "left_anti")
    return left.withColumn("message", F.concat(F.lit("'"), F.col("symbol"), F.lit("' is exported but nothing imports it")))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, target, line, column, ordinal) of resolved imports of other files; ordinal counts a file's edges in source order."""
    e = resolved(imports, files).filter("target <> file")
    return e.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("line", "column", "sequence")))


def cyclic_core(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """edges from which a cycle can be reached: those into files without such edges are peeled off, round by round.

    Files that only lead to a cycle stay: a search that starts there may be the first to meet it.
    """
    left, n = checkpointed(edges), None
    for _ in range(rounds):
        sources = left.select(F.col("file").alias("target")).distinct()
        left = checkpointed(left.join(sources, "target", "left_semi").select(*edges.columns))
        now = left.count()
        if now == n or not now:
            break
        n = now
    return left


#: Edges that one task searches by itself, at most: some hundred MB. Larger graphs are searched by joins; the results are the same.
ONE_TASK = 500_000


def circular_imports(edges: DataFrame, max_depth: int = 24, one_task: int = ONE_TASK) -> DataFrame:
    """Each cycle once: (file, line, column, path, message), at the edge that closes it when files are searched in order.

    From every file, in order, paths of distinct files grow edge by edge up to max_depth files; a path whose
    next edge leads back into it has found a cycle. Of all sightings of a cycle, the one that a depth-first
    search from sorted roots meets first is kept: the least (root, ordinals of the edges taken). Cycles of a
    dense graph are exponentially many, and all of them are results.
    """
    edges = checkpointed(edges.select("file", "target", "line", "column", "ordinal"))
    if edges.count() <= one_task:
        first = edges.coalesce(1).mapInPandas(lambda frames: _searched(frames, max_depth), "file string, line int, column int, cycle array<string>")
    else:
        first = _grown(edges, max_depth)
    path = F.concat("cycle", F.array(F.get("cycle", F.lit(0))))
    return first.select("file", "line", "column", path.alias("path"), F.concat(F.lit("circular import: "), F.array_join(path, " → ")).alias("message"))


def _searched(frames: Iterator[pd.DataFrame], max_depth: int) -> Iterator[pd.DataFrame]:
    """The cycles of a graph that fits into one task."""
    import pandas as pd

    whole = pd.concat([pd.DataFrame(columns=["file", "target", "line", "column", "ordinal"]), *frames])
    out: dict[str, list[tuple]] = {}
    for file, target, line, column, ordinal in whole.sort_values(["file", "ordinal"]).itertuples(index=False):
        out.setdefault(file, []).append((target, line, column))
    # only files from which a cycle can be reached are searched
    into, left = {}, {f: len(e) for f, e in out.items()}
    for f, e in out.items():
        for target, _, _ in e:
            into.setdefault(target, []).append(f)
    ends = [f for f in into if f not in out]
    while ends:
        for f in into.get(ends.pop(), ()):
            left[f] -= 1
            if not left[f]:
                ends.append(f)
    out = {f: [x for x in e if left.get(x[0])] for f, e in out.items() if left[f]}
    rows, seen = [], set()
    for root in sorted(out, key=lambda f: f.encode("utf-8", "surrogatepass")):
        path, place, walks = [root], {root: 0}, [iter(out[root])]
        while walks:
            edge = next(walks[-1], None)
            if edge is None:
                walks.pop()
                del place[path.pop()]
                continue
            target, line, column = edge
            back = place.get(target)
            if back is None:
                if len(path) < max_depth:
                    place[target] = len(path)
                    path.append(target)
                    walks.append(iter(out.get(target, ())))
                continue
            cycle = path[back:]
            least = cycle.index(min(cycle))
            key = tuple(cycle[least:] + cycle[:least])
            if key not in seen:
                seen.add(key)
                rows.append((path[-1], line, column, cycle))
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["file", "line", "column", "cycle"])
                    rows = []
    yield pd.DataFrame(rows, columns=["file", "line", "column", "cycle"])


def _grown(edges: DataFrame, max_depth: int) -> DataFrame:
    """The cycles of a graph of any size: all paths grow by one edge a round."""
    core = cyclic_core(edges).select(F.col("file").alias("last"), "target", "line", "column", "ordinal")
    paths = core.select(F.col("last").alias("root")).distinct().select("root", F.array("root").alias("path"), F.array().cast("array<int>").alias("ordinals"), F.col("root").alias("last"))
    found = None
    for depth in range(1, max_depth + 1):
        step = checkpointed(paths.join(core, "last"))
        back = F.array_position("path", F.col("target"))
        hits = step.filter(back > 0).select("root", F.array_append("ordinals", F.col("ordinal")).alias("ordinals"), F.col("last").alias("file"), "line", "column", F.slice("path", back.cast("int"), F.size("path")).alias("cycle"))
        found = hits if found is None else found.unionByName(hits)
        if depth == max_depth:
            break
        paths = step.filter(back == 0).select("root", F.array_append("path", F.col("target")).alias("path"), F.array_append("ordinals", F.col("ordinal")).alias("ordinals"), F.col("target").alias("last"))
        if paths.isEmpty():
            break
    turns = F.transform(F.sequence(F.lit(0), F.size("cycle") - 1), lambda i: F.concat(F.slice("cycle", i + 1, F.size("cycle")), F.slice("cycle", F.lit(1), i)))
    keyed = found.withColumn("key", F.array_min(turns))
    return keyed.groupBy("key").agg(F.min_by(F.struct("file", "line", "column", "cycle"), F.struct("root", "ordinals")).alias("x")).select("x.*")
