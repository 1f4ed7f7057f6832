"""Pruning before anything is parsed: path, content and language gates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.globs import any_glob


@dataclass(frozen=True)
class Gates:
    path_matches: list[str] = field(default_factory=list)
    path_not_matches: list[str] = field(default_factory=list)
    file_contains: list[str] = field(default_factory=list)
    file_not_contains: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        any_glob(self.path_matches, "pathMatches")
        any_glob(self.path_not_matches, "pathNotMatches")


def selects(path: Column, include: list[str], exclude: list[str]) -> Column:
    """exclude wins; without include everything is in."""
    out, within = any_glob(exclude, "exclude"), any_glob(include, "include")
    keep = F.lit(True) if within is None else path.rlike(within)
    return keep if out is None else keep & ~path.rlike(out)


def admits_path(path: Column, gates: Gates) -> Column:
    return selects(path, gates.path_matches, gates.path_not_matches)


def admits_any_path(path: Column, language: Column, rules: list) -> Column:
    """Whether some rule's language and path gate let a file in: all that can be known of it before it is read."""
    fits = [language.isin(*r.languages) & admits_path(path, r.gates) for r in rules]
    return F.coalesce(reduce(lambda a, b: a | b, fits, F.lit(False)), F.lit(False))


def admits_content(source: Column, gates: Gates) -> Column:
    """None of file_not_contains, all of file_contains; an empty needle is always contained."""
    wanted = reduce(lambda a, b: a & b, (F.contains(source, F.lit(n)) for n in gates.file_contains), F.lit(True))
    return reduce(lambda a, n: a & ~F.contains(source, F.lit(n)), gates.file_not_contains, wanted)


def admitted(files: DataFrame, rules: list, content: bool) -> DataFrame:
    """files with `rules`: indices of the rules that their language, path and, if asked, content let run; files without any go.

    Rules are those of a configuration that are not off by its word; they become one projection, not a join.
    """
    def fits(r) -> Column:
        ok = F.col("language").isin(*r.languages) & admits_path(F.col("file"), r.gates)
        return ok & admits_content(F.col("source"), r.gates) if content else ok

    found = F.array_compact(F.array(*(F.when(fits(r), F.lit(i)) for i, r in enumerate(rules)))) if rules else F.array().cast("array<int>")
    return files.withColumn("rules", found).filter(F.size("rules") > 0)
