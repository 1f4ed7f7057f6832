"""Scans: project trees with ignore files, stores that only Spark reads, and what git says has changed."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.globs import any_glob
from tessera.operators.gates import selects
from tessera.schemas import FILES, LANGUAGES


class ScanError(ValueError):
    """A root or a revision that cannot be read."""


def language_of(path: Column) -> Column:
    """The language that a path's extension names, ASCII case aside; null for others."""
    extension = F.lower(F.regexp_extract(path, "\\.([^./]*)\\z", 1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension)


# --- ignore files -----------------------------------------------------------------------------------


def _ignore_rules(text: str, folder: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern, negated, folders only) of an ignore file that stands in folder, in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only = line.endswith("/")
        line = line.rstrip("/").removeprefix("\\")
        rooted = "/" in line
        line = line.lstrip("/")
        parts, i = [], 0
        while i < len(line):  # a single star does not cross folders here
            if line.startswith("**/", i):
                parts.append("(?:.*/)?")
                i += 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                parts.append("/.*")
                i += 3
            elif line[i] == "*":
                parts.append("[^/]*")
                i += 1
            elif line[i] == "?":
                parts.append("[^/]")
                i += 1
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                parts.append("[" + line[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]")
                i = end + 1
            else:
                parts.append(re.escape(line[i]))
                i += 1
        head = re.escape(folder + "/") if folder else ""
        try:
            out.append((re.compile(head + ("" if rooted else "(?:.*/)?") + "".join(parts) + r"\Z", re.S), negated, only))
        except re.error:
            continue
    return out


def walk(root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Sorted paths, relative and with forward slashes, of the files below root that ignore files and globs leave in.

    Ignore files hold without a repository too; hidden files are in; what cannot be read is passed over.
    """
    out_of, within = (any_glob(p or [], n) for p, n in ((exclude, "exclude"), (include, "include")))
    out_of, within = (re.compile(x.replace("\\z", "\\Z").replace("\\A", "")) if x else None for x in (out_of, within))
    base = Path(root).resolve()
    if not base.is_dir():
        raise ScanError(f"cannot read project root `{root}`")
    found: list[str] = []
    rules: dict[str, list] = {"": []}
    for up in [*base.parents][::-1]:
        file = up / ".gitignore"
        if file.is_file() and any((d / ".git").exists() for d in (up, *up.parents)):
            for pattern, negated, only in _ignore_rules(file.read_text("utf-8", "replace"), ""):
                rules[""].append((pattern, negated, only))

    def ignored(path: str, folder: bool, active: list) -> bool:
        for pattern, negated, only in reversed(active):
            if (folder or not only) and pattern.match(path):
                return not negated
        return False

    for at, folders, names in os.walk(base, onerror=lambda _: None):
        here = os.path.relpath(at, base).replace(os.sep, "/")
        here = "" if here == "." else here
        active = list(rules.get(here, rules[""]))
        if ".gitignore" in names:
            try:
                active += _ignore_rules(Path(at, ".gitignore").read_text("utf-8", "replace"), here)
            except OSError:
                pass
        join = lambda n: f"{here}/{n}" if here else n
        folders[:] = sorted(f for f in folders if f != ".git" and not ignored(join(f), True, active))
        for f in folders:
            rules[join(f)] = active
        for n in names:
            p = join(n)
            if os.path.isfile(os.path.join(at, n)) and not ignored(p, False, active) and not (out_of and out_of.fullmatch(p)) and (within is None or within.fullmatch(p)):
                found.append(p)
    return sorted(found, key=lambda p: p.encode("utf-8", "surrogateescape"))


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """files of these paths below root."""
    return scan_listed(spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths) // 50 + 1, 10_000))), root)


def scan_listed(listed: DataFrame, root: str) -> DataFrame:
    """files of the listed paths (file) below root. Tasks read them; a file that is gone or is no UTF-8 has no row."""
    base = str(Path(root).resolve())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = [], []
            for p in b.column(0).to_pylist():
                try:
                    texts.append(Path(base, p).read_bytes().decode("utf-8"))
                    names.append(p)
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "source": pa.array(texts, pa.string())})

    return _as_files(listed.mapInArrow(read, "file string, source string"))


def _as_files(df: DataFrame) -> DataFrame:
    return df.select("file", language_of(F.col("file")).alias("language"), "source", F.sha2("source", 256).alias("content_hash"))


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    return scan_paths(spark, root, walk(root, include, exclude))


def scan_store(spark: SparkSession, uri: str, include: list[str] | None = None, exclude: list[str] | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """files below a folder of any store that Spark reads; names that Spark hides (leading . or _) are out. wanted: of a path, whether it is to be read at all."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(uri)
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "\\A" + re.escape(re.sub("^[a-z0-9]+:/+", "/", uri).rstrip("/")) + "/", "")
    # names are filtered before contents are read: they are metadata of the scan
    some = read.select(relative.alias("file"), "content").filter(selects(F.col("file"), include or [], exclude or []))
    some = some if wanted is None else some.filter(wanted(F.col("file")))
    return _as_files(some.filter(F.is_valid_utf8(F.col("content"))).select("file", F.decode("content", "UTF-8").alias("source")))


def scan_texts(table: DataFrame, path: Column, source: Column) -> DataFrame:
    """files from a table that holds paths and texts."""
    return _as_files(table.select(path.alias("file"), source.alias("source")).filter("source IS NOT NULL"))


def empty_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FILES)


# --- git ----------------------------------------------------------------------------------------------


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args, "-z"], capture_output=True, text=True)
    if done.returncode:
        raise ScanError(done.stderr.strip() or f"git {args[0]} failed")
    return [p for p in done.stdout.split("\0") if p]


def _present(root: str, paths: list[str]) -> list[str]:
    return sorted({p for p in paths if os.path.isfile(os.path.join(root, p))})


def changed_since(root: str, revision: str) -> list[str]:
    """Files that differ from a revision, and untracked ones that are not ignored; deleted ones are out."""
    return _present(root, _git(root, "diff", "--name-only", "--relative", revision) + _git(root, "ls-files", "--others", "--exclude-standard"))


def staged(root: str) -> list[str]:
    """Files with staged changes; deleted ones are out."""
    return _present(root, _git(root, "diff", "--cached", "--name-only", "--relative"))


def narrowed(files: DataFrame, selection: DataFrame) -> DataFrame:
    """files that are among a selection (file): an intersection, so what discovery leaves out stays out."""
    return files.join(selection.select("file").distinct(), "file", "left_semi")

