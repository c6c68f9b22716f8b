"""The keyed, versioned analysis table as a fold over an append-only log.

A log row is ``(key, op, ts, seq, created_hint, payload...)`` with ``op`` in
``put`` (upsert: replace payload), ``patch`` (whitelisted columns only; no-op on
a missing row), ``delete`` (tombstone) and ``snap`` (a compacted row).  The
current table is a fold, never an in-place update:

1. per key, the latest tombstone ``(ts, seq)``  — one partial aggregation;
2. rows after it survive; a key with no surviving put/snap has no row;
3. payload = latest put/snap; patched columns = latest put/snap/patch value
   (the latest of those is always at or after a put, so a patch that precedes
   every put can never win); ``created_at`` = earliest surviving put (a
   snapshot carries its original one); ``updated_at`` = latest put/patch.

A key may hold a third of all rows, so rows are dealt by key and salt, folded
to one row per key and salt, and then to one per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT_OPS = ("put", "snap")


def _order(ts: str = "ts", seq: str = "seq"):
    return F.struct(F.col(ts), F.col(seq))


#: Parts that every key's rows are dealt into before they are folded.
SALTS = 16


def fold(log: DataFrame, key: str, payload: list[str], patchable: list[str], salts: int = SALTS) -> DataFrame:
    """Fold a change log into the current table (one row per live key).

    Rows are dealt by (key, salt): the join with the latest tombstones, which
    are repeated for each salt, and the first aggregation share that
    partitioning, so a key with a third of the log is ``salts`` tasks' work.
    The second aggregation gets at most ``salts`` rows per key."""
    o = _order()
    salted = log.withColumn("__salt", F.pmod(F.xxhash64("ts", "seq"), F.lit(salts)).cast("int"))
    last_del = (log.where(F.col("op") == "delete")
                   .groupBy(key).agg(F.max(o).alias("__del"))
                   .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    live = (salted.where(F.col("op").isin("put", "snap", "patch"))
                  .join(last_del, [key, "__salt"], "left")
                  .where(F.col("__del").isNull() | (o > F.col("__del"))))
    is_put = F.col("op").isin(*PUT_OPS)
    # The rows that may decide a column: put/snap/patch rows that carry a
    # patchable one, put/snap rows for the others.
    at = {c: F.when(F.col(c).isNotNull() | is_put if c in patchable else is_put, o) for c in payload}
    part = live.groupBy(key, "__salt").agg(
        F.min(F.when(is_put, F.col("created_hint"))).alias("created_at"),
        F.max(F.when(is_put | (F.col("op") == "patch"), F.col("ts"))).alias("updated_at"),
        F.count(F.when(is_put, 1)).alias("__puts"),
        *[F.max_by(F.col(c), at[c]).alias(c) for c in payload], *[F.max(at[c]).alias(f"__at_{c}") for c in payload])
    out = part.groupBy(key).agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.sum("__puts").alias("__puts"),
        *[F.max_by(F.col(c), F.col(f"__at_{c}")).alias(c) for c in payload])
    return out.where(F.col("__puts") > 0).select(key, *payload, "created_at", "updated_at")


def dedup_latest(df: DataFrame, key: str, order_cols: list[str], keep: list[str]) -> DataFrame:
    """T5: one row per key, the latest by ``order_cols`` — ``max_by`` over a
    struct instead of ``row_number()`` so a hot key is pre-aggregated."""
    o = F.struct(*[F.col(c) for c in order_cols])
    latest = F.max_by(F.struct(*[F.col(c) for c in keep]), o).alias("__r")
    return df.groupBy(key).agg(latest).select(key, "__r.*")


def snapshot_rows(current: DataFrame, key: str, payload: list[str], seq_value) -> DataFrame:
    """Turn a folded table back into ``snap`` log rows for compaction (T4)."""
    return current.select(
        key, F.lit("snap").alias("op"), F.col("updated_at").alias("ts"),
        F.lit(seq_value).cast("long").alias("seq"), F.col("created_at").alias("created_hint"),
        *payload)


def compact(spark, log: DataFrame, key: str, payload: list[str], patchable: list[str],
            cutoff, path: str) -> DataFrame:
    """T4: fold the log up to ``cutoff`` into a snapshot written to ``path``
    (a table in the shared checkpoint folder, which also cuts lineage), then fold
    the snapshot together with the rest of the log."""
    older = log.where(F.col("ts") < F.lit(cutoff))
    newer = log.where(F.col("ts") >= F.lit(cutoff))
    snap = fold(older, key, payload, patchable)
    snap.write.mode("overwrite").parquet(path)
    snap = spark.read.parquet(path)
    # seq of a snapshot row: before any later row at the same ts is impossible,
    # since later rows have ts >= cutoff > updated_at.
    rows = snapshot_rows(snap, key, payload, -1)
    return fold(rows.unionByName(newer.select(rows.columns)), key, payload, patchable)
