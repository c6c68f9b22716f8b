"""R1, R3–R5 as registered plans (the batch forms of the streaming jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.state import fold
from ..sources.alerts_src import DUCK_ALERTS_CTE, raw_alerts
from ..sources.corpus import code_files, duck_code_cte
from ..sources.tables import read_table
from ..streaming.jobs import analysis_log, rolling_activity
from .registry import register


@register("rolling_24h", """
SELECT ws AS window_start, ws + INTERVAL 24 HOUR AS window_end, count(*) AS n_events
FROM (SELECT date_trunc('hour', ts) - to_hours(i) AS ws FROM events, range(0, 24) r(i)) t GROUP BY ws""")
def rolling_24h(spark, sf_dir):
    """Sliding 24 h / 1 h event counts (same plan as the streaming job)."""
    ev = read_table(spark, sf_dir, "events").select("ts")
    return rolling_activity(ev)


@register("alerts_ingest_once", f"WITH {DUCK_ALERTS_CTE} SELECT alert_id, alert_type, file_path, severity FROM alerts")
def alerts_ingest_once(spark, sf_dir):
    """R1 + R3: raw alerts that arrive twice are normalised and kept once, by id."""
    from ..operators.alerts import normalise
    raw = raw_alerts(spark, sf_dir)
    once = normalise(raw.unionByName(raw)).dropDuplicates(["alert_id"])
    return once.select("alert_id", "alert_type", "file_path", "severity")


@register("continuous_analysis", f"""WITH {duck_code_cte()}
SELECT file_path, language, CAST(CASE id % 3 WHEN 0 THEN 2 ELSE 1 END AS INTEGER) AS n_functions,
  CAST(CASE id % 3 WHEN 0 THEN 3 + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS n_imports FROM code""")
def continuous_analysis_fold(spark, sf_dir):
    """R4 + T1: all files arrive, then some Python files again with one import
    more; the log of both batches' records folds to the current table."""
    from ..operators.analysis import analyse, with_flat_columns
    code = code_files(spark, sf_dir)
    again = code.where("id % 3 = 0 AND id % 4 = 0").withColumn("content", F.concat("content", F.lit("import sys\n")))

    def log(files, hour, seq):
        ts = F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp_ntz")
        return analysis_log(with_flat_columns(analyse(files.select("file_path", "language", "content"))), ts, seq)
    rows = log(code, 1, 0).unionByName(log(again, 2, 1))
    return fold(rows, "file_path", ["language", "n_functions", "n_imports"], []).drop("created_at", "updated_at")
