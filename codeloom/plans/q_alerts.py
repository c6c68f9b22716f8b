"""L1, L2, L5, S7 over alerts derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..session import scratch_path
from ..sources.alerts_src import DUCK_ALERTS_CTE, alerts
from .registry import register

W = f"WITH {DUCK_ALERTS_CTE} "
COLS = "alert_id, alert_type, alert_message, file_path, line_number, severity, created_at"


@register("alerts_normalise", W + f"SELECT {COLS} FROM alerts")
def alerts_normalise(spark, sf_dir):
    """L1: id, default severity, created_at."""
    return alerts(spark, sf_dir)


@register("alert_text", W + "SELECT alert_id, concat_ws(' ', alert_type, alert_message) AS query_text FROM alerts")
def alert_text(spark, sf_dir):
    """L2: search text = type + ' ' + message."""
    return A.alert_text(alerts(spark, sf_dir)).select("alert_id", "query_text")


@register("alert_history", W + f"SELECT {COLS} FROM alerts ORDER BY created_at DESC, alert_id LIMIT 100")
def alert_history(spark, sf_dir):
    """The latest 100 alerts."""
    return A.history(alerts(spark, sf_dir), 100)


@register("alerts_append", W + f"SELECT {COLS} FROM alerts UNION ALL SELECT {COLS} FROM alerts")
def alerts_append(spark, sf_dir):
    """Two appends of the alert rows to one Parquet table, read back."""
    path = scratch_path(spark, "alert_data")
    a = alerts(spark, sf_dir)
    a.write.mode("append").parquet(path)
    a.write.mode("append").parquet(path)
    return spark.read.parquet(path).select(*[c.strip() for c in COLS.split(",")])
