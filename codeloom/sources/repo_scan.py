"""Repository scan → ``files`` and ``rejects`` DataFrames.

Neither listing nor reading runs on the driver:

1. **Manifest** — directories are listed level by level: each round deals the
   directories of one depth over all tasks, which return matching files, the
   next round's directories and what could not be listed.  A folder with most of
   the tree below it is so split at its sub-folders.  Hidden names (leading dot)
   are skipped, ``_``-prefixed ones kept; a directory whose name matches a
   pattern is not a file.  (Spark's ``binaryFile`` source is not used: it
   silently skips ``_`` names such as ``__init__.py``.)
2. **Read** — the manifest is dealt by file and ``mapInPandas`` reads the bytes,
   a bounded number of them per batch.

Then the language comes from the file suffix (P2) and the decode policy (S5)
splits accepted files from rejects; a reject tells its reason.  Paths must be
visible to every executor (a shared mount); other stores are refused.
"""

from __future__ import annotations

import fnmatch
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language_dim, resolve_by_extension
from ..session import materialize
from .decode import split_accepted

DEFAULT_PATTERNS = "*.py,*.go,*.java"
#: Bytes of files that one batch of the read step holds.
READ_BYTES = 32 << 20


def local_path(path: str) -> str:
    """A plain path from a path or ``file:`` address; other stores have no paths
    that Python's file calls can open."""
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path):
        if m[1].lower() != "file":
            raise ValueError(f"{path}: the scan needs a folder mounted on every executor")
        return re.sub(r"^file:/*", "/", path)
    return path


def _matches(name: str, patterns: list[str]) -> bool:
    return not name.startswith(".") and any(fnmatch.fnmatchcase(name, p) for p in patterns)


def _list_dirs(patterns: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for d in pdf["path"]:
                try:
                    with os.scandir(d) as it:
                        for e in it:
                            if e.name.startswith("."):
                                continue
                            if e.is_dir(follow_symlinks=False):
                                rows.append((e.path, "dir", None))
                            elif _matches(e.name, patterns) and e.is_file():
                                rows.append((e.path, "file", None))
                except OSError as err:
                    rows.append((d, "error", f"cannot list: {err.strerror}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "error"], dtype=object)
    return run


def list_files(spark: SparkSession, root: str, patterns: str = DEFAULT_PATTERNS, num_partitions: int | None = None) -> DataFrame:
    """(path, kind ``file`` or ``error``, error): all matching files below
    ``root`` and the directories that could not be listed.  A missing root is empty."""
    pats = [p.strip() for p in patterns.split(",") if p.strip()]
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "path string, kind string, error string"
    found = spark.createDataFrame([], schema)
    level = spark.createDataFrame([(root,)] if os.path.isdir(root) else [], "path string")
    while True:
        listed = materialize(level.repartition(n).mapInPandas(_list_dirs(pats), schema), "listing")
        found = found.unionByName(listed.where("kind <> 'dir'"))
        level = listed.where("kind = 'dir'").select("path")
        if level.isEmpty():
            return found


def _read_bytes(batches):
    def frame(rows):
        return pd.DataFrame(rows, columns=["file_path", "raw", "n_bytes", "error"])
    for pdf in batches:
        rows, held = [], 0
        for p in pdf["file_path"]:
            try:
                with open(p, "rb") as fh:
                    b = fh.read()
                rows.append((p, b, len(b), None))
                held += len(b)
            except OSError as err:
                rows.append((p, None, None, f"cannot read: {err.strerror}"))
            if held >= READ_BYTES:
                yield frame(rows)
                rows, held = [], 0
        yield frame(rows)


def scan_repo(spark: SparkSession, root: str, patterns: str = DEFAULT_PATTERNS,
              num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(files, rejects)``; ``files(file_path, language, content, n_bytes)``
    and ``rejects(file_path, language, n_bytes, reason)``: directories that could
    not be listed, files that could not be read, have no known language or do
    not decode."""
    manifest = list_files(spark, local_path(root), patterns, num_partitions)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = (manifest.where("kind = 'file'").select(F.col("path").alias("file_path")).repartition(n)
           .mapInPandas(_read_bytes, "file_path string, raw binary, n_bytes long, error string"))
    typed = resolve_by_extension(raw, "file_path", language_dim(spark))
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("language").isNull(), "unknown language")
    files, undecoded = split_accepted(typed.where(bad.isNull()).drop("error"), "raw")
    undecoded = undecoded.drop("raw")
    rejects = (undecoded.unionByName(typed.where(bad.isNotNull()).select("file_path", "n_bytes", "language", bad.alias("reason")).select(*undecoded.columns))
               .unionByName(manifest.where("kind = 'error'").select(F.col("path").alias("file_path"), F.lit(None).cast("long").alias("n_bytes"),
                                                                    F.lit(None).cast("string").alias("language"), F.col("error").alias("reason")).select(*undecoded.columns)))
    return files, rejects


def _write_files(root: str, stray: tuple[str, bytes] | None):
    def run(batches):
        for pdf in batches:
            for p, c in zip(pdf["file_path"], pdf["content"]):
                full = os.path.join(root, p.lstrip("/"))
                os.makedirs(os.path.dirname(full), exist_ok=True)
                data = c.encode()
                if stray:
                    data = data.replace(stray[0].encode(), stray[1])
                with open(full, "wb") as fh:
                    fh.write(data)
            yield pd.DataFrame({"n": [len(pdf)]})
    return run


def write_tree(files: DataFrame, root: str, stray: tuple[str, bytes] | None = None) -> int:
    """Write ``files(file_path, content)`` as a directory tree under ``root``
    (a distributed, idempotent write: a retried task rewrites the same files).
    ``stray``: a string to be written as these bytes instead."""
    out = files.select("file_path", "content").mapInPandas(_write_files(local_path(root), stray), "n long")
    return int(out.agg(F.sum("n")).first()[0] or 0)
