"""Database statistics as one-row aggregates (each a partial+final agg)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lines import line_metric_cols
from ..operators import stats as S
from ..sources.alerts_src import DUCK_ALERTS_CTE, alerts
from ..sources.corpus import code_files, duck_code_cte
from .registry import register

W = f"WITH {duck_code_cte()}, {DUCK_ALERTS_CTE} "


@register("stats_totals", W + """SELECT (SELECT count(*) FROM code) AS total_analysis_results,
  (SELECT count(*) FROM alerts) AS total_alerts""")
def stats_totals(spark, sf_dir):
    """A2 + A3."""
    return S.totals(code_files(spark, sf_dir), alerts(spark, sf_dir))


@register("recent_24h", """SELECT count(*) AS recent_count FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def recent_24h(spark, sf_dir):
    """A5 with as_of = latest event (reproducible; never wall-clock time)."""
    from ..sources.tables import read_table
    ev = read_table(spark, sf_dir, "events").select("ts")
    return S.recent_count(ev, "ts", S.as_of_max(ev, "ts"), hours=24)


@register("database_stats", W + """SELECT
  (SELECT count(*) FROM code) AS total_analysis_results,
  (SELECT count(*) FROM alerts) AS total_alerts,
  (SELECT string_agg(language || '=' || CAST(n AS VARCHAR), ',' ORDER BY language)
     FROM (SELECT language, count(*) AS n FROM code GROUP BY language) g) AS language_distribution,
  (SELECT count(*) FROM code WHERE created_at >= (SELECT max(created_at) FROM code) - INTERVAL 24 HOUR)
     AS recent_analysis_results""")
def database_stats(spark, sf_dir):
    """The combined stats record (one row)."""
    return S.database_stats(code_files(spark, sf_dir), alerts(spark, sf_dir))
