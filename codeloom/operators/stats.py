"""A2–A6 statistics.  Every statistic is a global aggregate (partial per
partition, one tiny final merge); the combined record joins one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tagged(analysis: DataFrame, alerts: DataFrame) -> DataFrame:
    """One stream of rows from both tables (no join): ``is_alert`` tells them apart."""
    a = analysis.select("language", "created_at", F.lit(0).alias("is_alert"))
    b = alerts.select(F.lit(None).cast("string").alias("language"),
                      F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("is_alert"))
    return a.unionByName(b)


def totals(analysis: DataFrame, alerts: DataFrame) -> DataFrame:
    u = _tagged(analysis.select("language", "created_at"), alerts)
    return u.agg(F.count(F.when(F.col("is_alert") == 0, 1)).alias("total_analysis_results"),
                 F.count(F.when(F.col("is_alert") == 1, 1)).alias("total_alerts"))


def as_of_max(df: DataFrame, ts: str) -> Column:
    """Scalar subquery: the latest timestamp of ``df`` (explicit as-of)."""
    return df.agg(F.max(ts)).first()[0]


def recent_count(df: DataFrame, ts: str, as_of, hours: int = 24) -> DataFrame:
    lo = F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(F.col(ts) >= lo).agg(F.count(F.lit(1)).alias("recent_count"))


def language_distribution(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("language").agg(F.count(F.lit(1)).alias("count"))


def distribution_text(dist: DataFrame) -> DataFrame:
    """The histogram as one sorted ``lang=n,...`` string (map key order is not
    stable across engines; the map form is ``map_from_entries``)."""
    return dist.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat(F.col("language"), F.lit("="), F.col("count").cast("string")))), ",")
        .alias("language_distribution"))


def distribution_map(dist: DataFrame) -> DataFrame:
    return dist.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "count"))))
                    .alias("language_distribution"))


def database_stats(analysis: DataFrame, alerts: DataFrame, as_of=None) -> DataFrame:
    base = analysis.select("language", "created_at")
    if as_of is None:
        as_of = as_of_max(base, "created_at")
    lo = F.lit(as_of) - F.expr("INTERVAL 24 HOURS")
    per_lang = (_tagged(base, alerts).groupBy("language", "is_alert")
                .agg(F.count(F.lit(1)).alias("n"),
                     F.count(F.when(F.col("created_at") >= lo, 1)).alias("recent")))
    an = F.col("is_alert") == 0
    return per_lang.agg(
        F.coalesce(F.sum(F.when(an, F.col("n"))), F.lit(0)).alias("total_analysis_results"),
        F.coalesce(F.sum(F.when(~an, F.col("n"))), F.lit(0)).alias("total_alerts"),
        F.array_join(F.array_sort(F.collect_list(F.when(an, F.concat(
            F.col("language"), F.lit("="), F.col("n").cast("string"))))), ",").alias("language_distribution"),
        F.coalesce(F.sum(F.when(an, F.col("recent"))), F.lit(0)).alias("recent_analysis_results"))
