"""T1–T5 and S6 over the events change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots, state
from ..session import materialize, scratch_path
from ..sources.changelog import KEY, PATCHABLE, PAYLOAD, duck_fold_sql, events_log
from ..sources.tables import read_table
from .registry import register


def _fold(spark, sf_dir, ops):
    return state.fold(events_log(spark, sf_dir, ops), KEY, PAYLOAD, PATCHABLE)


@register("upsert_fold", duck_fold_sql(("put",)))
def upsert_fold(spark, sf_dir):
    """Upserts only — latest payload, first created_at, last updated_at."""
    return _fold(spark, sf_dir, ("put",))


@register("patch_fold", duck_fold_sql(("put", "patch")))
def patch_fold(spark, sf_dir):
    """Partial updates of the whitelisted column; patch-only keys have no row."""
    return _fold(spark, sf_dir, ("put", "patch"))


@register("delete_fold", duck_fold_sql(("put", "delete")))
def delete_fold(spark, sf_dir):
    """Tombstones remove a key; a later put starts a new row."""
    return _fold(spark, sf_dir, ("put", "delete"))


@register("changelog_fold", duck_fold_sql(("put", "patch", "delete")))
def changelog_fold(spark, sf_dir):
    """T1+T2+T3 together: the current analysis table."""
    return _fold(spark, sf_dir, ("put", "patch", "delete"))


@register("compact", duck_fold_sql(("put", "patch", "delete")))
def compact(spark, sf_dir):
    """T4: snapshot of the log before the median timestamp, written to the shared
    checkpoint folder and folded with the rest — must equal the direct fold."""
    log = events_log(spark, sf_dir)
    cutoff = log.agg(F.percentile_approx("ts", 0.5)).first()[0]
    return state.compact(spark, log, KEY, PAYLOAD, PATCHABLE, cutoff, scratch_path(spark, "snapshot"))


@register("incremental_fold", duck_fold_sql(("put", "patch", "delete")))
def incremental_fold(spark, sf_dir):
    """T1 + T4: the log arrives in four batches by time; each rewrites the key
    buckets it touches of the versioned table, which must equal the direct fold."""
    log = materialize(events_log(spark, sf_dir), "log")
    cuts = log.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0]
    table = scratch_path(spark, "versions")
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        batch = log.where((F.lit(True) if lo is None else F.col("ts") >= F.lit(lo)) & (F.lit(True) if hi is None else F.col("ts") < F.lit(hi)))
        snapshots.apply_log(spark, table, batch, KEY, PAYLOAD, PATCHABLE, batch_id=i, buckets=16)
    now = snapshots.current_table(spark, table)
    return state.fold(log, KEY, PAYLOAD, PATCHABLE).limit(0) if now is None else now


@register("dedup_latest", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
WHERE rn = 1""")
def dedup_latest(spark, sf_dir):
    """T5: duplicate rows of a key collapse to the latest one."""
    ev = read_table(spark, sf_dir, "events")
    return state.dedup_latest(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


@register("sink_roundtrip", """
SELECT user_id, op, ts, seq, value, props, kind FROM (SELECT user_id,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'put' WHEN 'click' THEN 'patch'
  WHEN 'error' THEN 'delete' END AS op, ts, event_id AS seq,
  CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type IN ('signup', 'purchase') THEN props END AS props,
  CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS kind FROM events) t
WHERE op IS NOT NULL""")
def sink_roundtrip(spark, sf_dir):
    """Append the log to Parquet partitioned by ``op`` and read it back."""
    path = scratch_path(spark, "analysis_log")
    log = events_log(spark, sf_dir).drop("created_hint")
    log.write.mode("append").partitionBy("op").parquet(path)
    back = spark.read.parquet(path)
    return back.select("user_id", "op", "ts", "seq", "value", "props", "kind")
