"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; an own folder only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own[0]


#: Folders of intermediate tables that are still there.
_made: list[str] = []


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _new_table(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    fs, at = _folder(df.sparkSession, path)
    fs.deleteOnExit(at)
    _made.append(path)
    df.table_folder = path
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Iterations then neither grow their plan nor redo their past, and a lost executor costs a re-read, never a
    recomputation that could order ties differently. The table goes when scratch() ends, or the driver.
    """
    path = _new_table(df.sparkSession)
    df.write.parquet(path)
    return _kept(df.sparkSession.read.schema(df.schema).parquet(path), path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """checkpointed(), in as many buckets by a key as a shuffle has partitions: joins and groups by it then take the rows from where they are."""
    spark, path = df.sparkSession, _new_table(df.sparkSession)
    name = f"tessera_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # the table is looked up, before its name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return _kept(out, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Intermediate tables that are made within are deleted at the end, but those that checkpointed() gave and that are put into the list."""
    start, keep = len(_made), []
    try:
        yield keep
    finally:
        held = {df.table_folder for df in keep}
        for path in _made[start:]:
            if path not in held:
                fs, at = _folder(spark, path)
                fs.delete(at, True)
                _made.remove(path)


def at_once(spark: SparkSession, *work: Callable) -> list:
    """The results of functions that wait for jobs of their own; the jobs share the cluster, and the caller's tags."""
    if len(work) < 2:
        return [f() for f in work]
    with ThreadPoolExecutor(min(8, len(work))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]
