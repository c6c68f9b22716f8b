"""Alerts derived from ``events``: every event is an alert about the code file
whose id is the event's user (so alerts and the corpus share file paths)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import normalise
from .tables import read_table

FILE_OF_USER = ("concat('/repo/b', CAST(user_id % 25 AS STRING), '/f_', CAST(user_id AS STRING), '.', "
                "CASE user_id % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'java' END)")
LINE_EXPR = "CAST(event_id % 20 AS INTEGER)"


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return ev.select(
        F.col("event_id").alias("source_id"),
        F.col("event_type").alias("alert_type"),
        F.col("props").alias("alert_message"),
        F.expr(FILE_OF_USER).alias("file_path"),
        F.expr(LINE_EXPR).alias("line_number"),
        F.when(F.col("event_type") == "error", F.lit("high")).alias("severity"),
        F.col("ts").alias("created_at"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(raw_alerts(spark, sf_dir))


DUCK_ALERTS_CTE = f"""alerts AS (SELECT md5(concat_ws('|', 'alert', CAST(event_id AS VARCHAR))) AS alert_id,
  event_type AS alert_type, props AS alert_message, {FILE_OF_USER} AS file_path, {LINE_EXPR} AS line_number,
  coalesce(CASE WHEN event_type = 'error' THEN 'high' END, 'medium') AS severity, ts AS created_at
  FROM events)"""
