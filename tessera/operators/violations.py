"""Shaping, severity and the one canonical order of violations; numbering of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The canonical order; what follows line and column only breaks ties, so that runs agree.
ORDER = ("rule_ns", "rule_name", "file", "line", "column")


def resolved_severity(override: Column, declared: Column) -> Column:
    """The configuration's word, else the rule's, else error."""
    return F.coalesce(override, declared, F.lit("error"))


def canonical(violations: DataFrame, *ties: str) -> DataFrame:
    """Sorted by (namespace, name), file, line, column: on two columns, as `a-b/x` and `a/x` order otherwise when rendered."""
    return violations.orderBy(*ORDER, *ties)


def failing(violations: DataFrame, warn_only: bool = False) -> DataFrame:
    """One row: ok, and the exit code: 1 if any violation is an error and warnings are not all that is asked for."""
    bad = F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))
    return violations.agg(bad.alias("bad")).select((~F.col("bad")).alias("ok"), F.when(F.col("bad") & F.lit(not warn_only), 1).otherwise(0).alias("exit_code"))


def numbered(facts: DataFrame, *emitted: str) -> DataFrame:
    """facts with sequence: their place within rule and file, by the order in which they were emitted."""
    w = Window.partitionBy("rule_ns", "rule_name", "file").orderBy(*emitted)
    return facts.withColumn("sequence", (F.row_number().over(w) - 1).cast("int"))


def positioned(df: DataFrame, *order: str) -> DataFrame:
    """df with position: its place, from 1, in the total order. Range partitions are numbered on their own and offset by the sizes of those before."""
    from tessera.operators.tables import checkpointed

    parts = checkpointed(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.withColumn("row_", within).join(F.broadcast(offsets), "part_").withColumn("position", (F.col("row_") + F.col("offset_")).cast("long")).drop("part_", "row_", "offset_")
