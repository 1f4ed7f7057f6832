"""Safe fixes: greedy selection without overlaps, and byte-exact application."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIX = "struct<start:bigint,end:bigint,replacement:string>"


def selected(ranges: list[tuple[int, int]]) -> list[int]:
    """Places, in order of application, of the ranges that are taken: by (start, end), one that overlaps the last taken is passed over."""
    out, last = [], None
    for k in sorted(range(len(ranges)), key=lambda k: (*ranges[k], k)):
        a, b = ranges[k]
        if last is None or not (last[0] < b and a < last[1]):
            out.append(k)
            last = (a, b)
    return out


def spliced(source: bytes, fixes: list[dict]) -> bytes:
    """source with taken fixes, which are in order and apart, applied; one that would split a character is declined."""
    inside = lambda at: at < len(source) and source[at] & 0xC0 == 0x80
    parts, at = [], 0
    for f in fixes:
        if not inside(f["start"]) and not inside(f["end"]) and f["start"] >= at:
            parts += [source[at : f["start"]], f["replacement"].encode("utf-8")]
            at = f["end"]
    return b"".join([*parts, source[at:]])


def chosen(fixes: Column, length: Column) -> Column:
    """Of an array of fixes (start, end, replacement, safe), those to apply.

    Safe ones within the text, by (start, end); one that overlaps the last chosen is passed over. Ranges
    that only touch do not overlap, and an empty range overlaps one that it lies strictly within. Which is
    taken depends on which was taken last, so each file's are folded in a loop, linear in their number: a
    fold that grows an array in Spark copies it at every step.
    """

    @F.arrow_udf(f"array<{_FIX}>")
    def choose(rows: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for fixes_, size in zip(rows.to_pylist(), lengths.to_pylist(), strict=True):
            usable = [f for f in fixes_ or [] if f["safe"] and 0 <= f["start"] <= f["end"] <= size]
            taken = [usable[k] for k in selected([(f["start"], f["end"]) for f in usable])]
            out.append([{"start": f["start"], "end": f["end"], "replacement": f["replacement"]} for f in taken])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())])))

    return choose(fixes, length.cast("bigint"))


def splice(source: Column, fixes: Column) -> Column:
    """source with chosen fixes applied, cut once; one that would split a character is declined."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array, taken: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spliced(t.encode("utf-8"), f or []).decode("utf-8") for t, f in zip(texts.to_pylist(), taken.to_pylist(), strict=True)], pa.string())

    return apply(source, fixes)


def apply_fixes(files: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per file with fixes: file, source (fixed), applied, skipped, changed.

    A fix that would split a character counts as applied, though the text stays.
    """
    gathered = violations.filter("fix IS NOT NULL").groupBy("file").agg(F.collect_list("fix").alias("fixes"))
    joined = files.join(gathered, "file").withColumn("take", chosen(F.col("fixes"), F.octet_length("source")))
    fixed = splice(F.col("source"), F.col("take"))
    offered = F.size(F.filter("fixes", lambda f: f["safe"]))
    return joined.select("file", fixed.alias("source"), F.size("take").cast("int").alias("applied"), (offered - F.size("take")).cast("int").alias("skipped"), (fixed != F.col("source")).alias("changed"))
