"""Watching: streams whose every batch is a run over what has changed.

`watch` follows a folder of a store that Spark reads, where files only arrive. `watch_tree` follows a project
tree, with edits and deletions, through a data source of its own: an offset names a snapshot of the tree, and
a batch is what differs between two of them, so a batch can be read again from its checkpoint.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import traceback
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

#: Folders whose files never start a run.
IGNORED = (".git", ".tessera", "node_modules", "target", "dist", "build", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".expo")
#: Events that come closer together than this are one.
PAUSE = "150 milliseconds"


def interesting(path: str) -> bool:
    """Whether a change of this path, relative to the root, is worth a run."""
    return not any(part in IGNORED for part in path.split("/"))


def snapshot(root: str) -> dict[str, list[int]]:
    """Time of change and size of every file below root that may start a run; what cannot be read is passed over."""
    out = {}
    for at, folders, names in os.walk(root, onerror=lambda _: None):
        folders[:] = sorted(f for f in folders if f not in IGNORED)
        here = os.path.relpath(at, root).replace(os.sep, "/")
        for n in sorted(names):
            try:
                s = os.stat(os.path.join(at, n))
            except OSError:
                continue
            out[n if here == "." else f"{here}/{n}"] = [s.st_mtime_ns, s.st_size]
    return out


def changes(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str]]:
    """(path, added, edited or deleted) of what differs, by path."""
    out = [(p, "added" if p not in before else "edited") for p, x in after.items() if before.get(p) != x]
    return sorted(out + [(p, "deleted") for p in before.keys() - after.keys()])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, Path(state)

    def _keep(self, files: dict[str, list[int]]) -> dict:
        text = json.dumps(files, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        self.state.mkdir(parents=True, exist_ok=True)
        if not (self.state / name).exists():
            (self.state / f"{name}.new").write_text(text)
            (self.state / f"{name}.new").rename(self.state / name)
        return {"snapshot": name}

    def _known(self, offset: dict) -> dict[str, list[int]]:
        return json.loads((self.state / offset["snapshot"]).read_text()) if offset.get("snapshot") else {}

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        after = snapshot(self.root)
        return iter(changes(self._known(start), after)), self._keep(after)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(changes(self._known(start), self._known(end)))

    def commit(self, end: dict) -> None:
        for f in self.state.iterdir():  # older snapshots are never asked for again
            if f.name != end["snapshot"] and f.stat().st_mtime < (self.state / end["snapshot"]).stat().st_mtime - 60:
                f.unlink(missing_ok=True)


class TreeSource(DataSource):
    """Options: root, the project; state, a folder for its snapshots."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tree"

    def schema(self) -> str:
        return "file string, change string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["root"], self.options["state"])


def _said(error: Exception) -> None:
    print("".join(traceback.format_exception_only(error)).strip(), file=sys.stderr)


def watch_tree(spark: SparkSession, root: str, run: Callable[[DataFrame, int], None], checkpoint: str, every: str = PAUSE, on_error: Callable[[Exception], None] = _said) -> StreamingQuery:
    """Start a stream over the changes of a tree; run gets (file, change) of each batch and its number; the first holds every file.

    A run that fails is told to on_error and the stream goes on: the next change may mend it.
    """
    spark.dataSource.register(TreeSource)
    stream = spark.readStream.format("tessera_tree").option("root", root).option("state", f"{checkpoint}-snapshots").load()

    def batch(df: DataFrame, n: int) -> None:
        if df.isEmpty():
            return
        try:
            run(df, n)
        except Exception as e:  # whatever a rule or the project did wrong
            on_error(e)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def watch(spark: SparkSession, folder: str, schema: str, run: Callable[[DataFrame, int], None], checkpoint: str, format: str = "parquet", available_now: bool = False, every: str = PAUSE) -> StreamingQuery:
    """Start a stream over new files of a folder; run gets each batch and its number.

    A batch that fails is retried by the stream from its checkpoint; with available_now the stream ends when
    what is there has been seen.
    """
    stream = spark.readStream.schema(schema).format(format).load(folder)
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()
