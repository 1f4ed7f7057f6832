"""The content-addressed result cache: keys, validation, and what a run leaves behind."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def field_hash(*fields: Column) -> Column:
    """A digest of fields, each with its length before it, so that no two lists of fields run together."""
    parts = [p for f in fields for p in (F.octet_length(f).cast("string"), f)]
    return F.sha2(F.concat_ws(":", *parts), 256)


def config_hash(include: list[str], exclude: list[str], severity: dict[str, str], limits: dict, rules: list) -> str:
    """Driver-side digest of what a configuration asks for; globs and severities count as sets, rules in order."""
    known = [sorted(include), sorted(exclude), sorted(severity.items()), sorted(limits.items()), rules]
    return hashlib.sha256(json.dumps(known, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def keys(files: DataFrame, run: str, today: str) -> DataFrame:
    """files with content_hash, key (run, path, content) and dated_key (and the date)."""
    content = F.sha2(F.col("source"), 256)
    return files.withColumn("content_hash", content).withColumn("key", field_hash(F.lit(run), F.col("file"), F.col("content_hash"))).withColumn("dated_key", field_hash(F.lit(run), F.col("file"), F.col("content_hash"), F.lit(today)))


def valid_keys(reads: DataFrame, current: DataFrame) -> DataFrame:
    """Keys all of whose recorded reads (key, path, hash) are as now; a null hash records that the file was absent.

    current: (path, hash) of files that exist.
    """
    now = current.withColumnRenamed("hash", "now")
    return reads.join(now, "path", "left").groupBy("key").agg(F.bool_and(F.col("hash").eqNullSafe(F.col("now"))).alias("fresh")).filter("fresh").select("key")


def hits(files: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, and the fields of entries) of files (file, key, dated_key, dated) that are cached.

    A file is found by its dated key, or by its plain one unless it names an expiry (dated).
    """
    either = files.select("file", F.explode(F.array_compact(F.array("dated_key", F.when(~F.col("dated"), F.col("key"))))).alias("key"))
    return either.join(entries, "key").groupBy("file").agg(F.min_by(F.struct(*entries.columns), "key").alias("x")).select("file", "x.*")


def stale_keys(reads: DataFrame, sides: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """Keys some of whose recorded reads (key, path, hash) are no longer as they were; sides: the text and digest of the files that rules may read."""
    spark = reads.sparkSession
    now = spark.createDataFrame([(p, h) for p, (_, h) in sides.items() if h is not None], "path string, hash string")
    return reads.select("key").distinct().join(valid_keys(reads, now), "key", "left_anti")


def merged(old: DataFrame, new: DataFrame, whole: bool) -> DataFrame:
    """What is stored after a run: a whole, successful run's entries alone, else the old ones that were not seen again and the new."""
    return new if whole else old.join(new.select("key"), "key", "left_anti").unionByName(new)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored entries; none if there is no store or it cannot be read."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.agg(F.max(found.columns[0])).collect()
        return found
    except (PySparkException, Py4JError):  # a damaged store is an empty one
        return spark.createDataFrame([], schema)


def save(entries: DataFrame, store: str, name: str = "entries") -> None:
    """Write entries beside the stored ones and then take their place, so that a broken run leaves the old ones."""
    spark = entries.sparkSession
    entries.write.mode("overwrite").parquet(f"{store}/next-{name}")
    jvm = spark._jvm
    here, to = (jvm.org.apache.hadoop.fs.Path(f"{store}/{n}") for n in (f"next-{name}", name))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    fs.rename(here, to)
