"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.support import materialize


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node are hung on its smallest neighbour: the larger ones, or the smaller ones and the node itself."""
    if large:
        around = _both(e)
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (u, v) -> (node, root): root is the smallest node of its component; unlinked nodes do not show.

    Each round is written out, so neither the plan nor a lost executor's work grows with the rounds. The
    state is one row per edge at most; nothing of it comes to the driver but a count and a checksum.
    """
    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        """df written out, with its number of rows and a checksum, which the write itself observes."""
        seen = Observation()
        low = F.xxhash64("u", "v").bitwiseAND(F.lit(0x7FFFFFFF))
        out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(low).alias("sum")))
        return out, (seen.get["n"], seen.get["sum"])

    e, was = settle(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if not was[0]:
            break
        e, now = settle(_star(_star(e, True).filter("u <> v"), False).filter("u <> v").distinct())
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
