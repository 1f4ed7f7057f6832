"""Relative import specifiers resolved to files of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that an import may leave out, in order of preference.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def joined_path(file: Column, specifier: Column) -> Column:
    """The path that a relative specifier names, lexically; `..` at the root goes nowhere."""
    folder = F.when(F.contains(file, F.lit("/")), F.regexp_replace(file, "/[^/]*\\z", "")).otherwise("")
    start = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))

    def step(path: Column, part: Column) -> Column:
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(part.isin("", "."), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    return F.array_join(F.aggregate(F.split(specifier, "/"), start, step), "/")


def resolved(edges: DataFrame, files: DataFrame, specifier: str = "specifier") -> DataFrame:
    """edges (file, specifier, ...) that name a file of the corpus, with target: as written, else with an extension, else its index file."""
    base = F.col("base")
    tries = [base, *(F.concat(base, F.lit(f".{e}")) for e in EXTENSIONS), *(F.concat(base, F.lit(f"/index.{e}")) for e in EXTENSIONS)]
    named = edges.filter(F.startswith(F.col(specifier), F.lit("."))).select("file", specifier).distinct().withColumn("base", joined_path(F.col("file"), F.col(specifier)))
    rows = named.select("file", specifier, F.posexplode(F.array(*tries)).alias("priority", "target"))
    known = rows.join(files.select(F.col("file").alias("target")), "target", "left_semi")
    best = known.groupBy("file", specifier).agg(F.min_by("target", "priority").alias("target"))
    return edges.join(best, ["file", specifier])
