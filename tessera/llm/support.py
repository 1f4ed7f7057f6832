"""Shared pieces: intermediate tables, vectorised word hashing, pass-through Arrow maps."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.tables import bucketed, scratch
from tessera.operators.tables import checkpointed as materialize

__all__ = ["bucketed", "materialize", "scratch"]

#: A-Z to a-z, for both arguments of translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the corpus contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t-\\r]+"

def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lower_az(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores after it, whichever df does not have (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def words_expr(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def word_count_expr(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def running(df: DataFrame, order: list[Column], position: str, **sums: str) -> DataFrame:
    """df with its place, from 0, in an order, and the sums of columns over all rows before each.

    Rows are dealt by ranges of the order and numbered on their own; one row for each range is ordered in
    one task. sums: new column -> column.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part_").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part_").agg(F.count("*").alias(position), *[F.sum(c).alias(n) for n, c in sums.items()])
    names = [position, *sums]
    offsets = totals.select("part_", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_offset_") for n in names])
    own = {position: F.row_number().over(within) - 1} | {n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in sums.items()}
    out = parts.withColumns(own).join(F.broadcast(offsets), "part_")  # a row for each partition of a shuffle
    return out.withColumns({n: F.col(n) + F.col(f"{n}_offset_") for n in names}).drop("part_", *[f"{n}_offset_" for n in names])


def slices(column: pa.Array, most: int, *more: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of rows whose values in a text column (and more such) hold `most` bytes at most, or of single rows."""
    sizes = sum(pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (column, *more))
    ends = np.cumsum(sizes)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b - a
        a = b


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with what its task held given back to the system at the end: Python workers outlive their tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


# --- vectorised hashing of words -------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(piece: np.ndarray) -> np.ndarray:
    space = _SPACE[piece]
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.uint64)
    where = np.arange(len(piece), dtype=np.int32)
    first = np.maximum.accumulate(np.where(start, where, 0))
    at = where - first
    terms = _BYTE[piece] * _POWERS[at & 4095]
    if len(piece) > 4096:
        far = at > 4095
        if far.any():
            terms[far] *= mix((at[far] >> 12).astype(np.uint64)) | np.uint64(1)
    terms[space] = 0
    return mix(np.add.reduceat(terms, starts))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of one text, A-Z lower-cased; works through long texts in pieces."""
    if len(text) <= CHUNK:
        return _hash_piece(_FOLD[np.frombuffer(text, np.uint8)])
    folded, out, at = _FOLD[np.frombuffer(text, np.uint8)], [], 0
    while at < len(folded):
        end = min(len(folded), at + CHUNK)
        if end < len(folded):
            cuts = np.flatnonzero(_SPACE[folded[at:end]])
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:  # one word longer than a piece
                more = np.flatnonzero(_SPACE[folded[end:]])
                end = end + int(more[0]) if len(more) else len(folded)
        out.append(_hash_piece(folded[at:end]))
        at = end
    return np.concatenate(out)


def batch_word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """word_hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if group:
            hashes = _hash_piece(_FOLD[np.frombuffer(b"\n".join(texts[i] for i in group), np.uint8)])
            ends = np.cumsum([len(texts[i].split()) for i in group])
            for i, a, b in zip(group, [0, *ends[:-1]], ends, strict=True):
                out[i] = hashes[a:b]
        group, held = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > CHUNK // 4:
            out[i] = word_hashes(t)
            continue
        group.append(i)
        held += len(t)
        if held > CHUNK // 2:
            flush()
    flush()
    return out
