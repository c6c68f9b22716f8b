"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import materialize, scratch_path  # noqa: F401  (re-exported)

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (null counts as empty)."""
    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def row_groups(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def ascii_lower(col):
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit keys."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unique_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, one for each wanted."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


#: Rows up to which a counted side is sent to every executor.
BROADCAST_ROWS = 50_000


def join_counted(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Join a grouped table whose rows, with the entries of its array ``items``,
    are counted first: broadcast when few, else a shuffled join, whose hot keys
    adaptive execution splits (``right`` must be a written table for that)."""
    size = F.lit(1) + F.size(items) if items else F.lit(1)
    few = (right.agg(F.sum(size)).first()[0] or 0) <= limit
    return left.join(F.broadcast(right) if few else right, on, how)
