"""L1–L6 alerts: normalisation, query text, history, related code, enclosing span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The four placeholder suggestions attached to every alert analysis.
SUGGESTED_FIXES = [
    "Review the code logic around the alert location",
    "Check for proper error handling",
    "Verify input validation",
    "Consider adding logging for debugging",
]

DEFAULT_SEVERITY = "medium"


def normalise(raw: DataFrame) -> DataFrame:
    """L1: deterministic id (retries are idempotent), default severity, created_at.

    ``raw`` has alert_type, alert_message, file_path, line_number, severity,
    created_at and a stable ``source_id``."""
    return raw.select(
        F.md5(F.concat_ws("|", F.lit("alert"), F.col("source_id").cast("string"))).alias("alert_id"),
        "alert_type", "alert_message", "file_path", "line_number",
        F.coalesce(F.col("severity"), F.lit(DEFAULT_SEVERITY)).alias("severity"),
        "created_at")


def alert_text(alerts: DataFrame) -> DataFrame:
    """L2: the text an alert is searched with."""
    return alerts.withColumn("query_text", F.concat_ws(" ", "alert_type", "alert_message"))


def history(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """Latest ``limit`` alerts (a top-k: TakeOrderedAndProject)."""
    return alerts.orderBy(F.col("created_at").desc(), F.col("alert_id")).limit(limit)


def with_suggestions(df: DataFrame) -> DataFrame:
    """L4: the constant suggestion list, a literal column."""
    return df.withColumn("suggested_fixes", F.array(*[F.lit(s) for s in SUGGESTED_FIXES]))


LINE_BUCKET = 64


def enclosing_function(alerts: DataFrame, analysis: DataFrame, bucket: int = LINE_BUCKET) -> DataFrame:
    """The innermost function whose definition spans the alert's line.

    A range join done as an equi-join: each function span is exploded into the
    ``bucket``-line blocks it covers, each alert looks up its own block, and
    containment is checked on the few candidates sharing ``(file_path, block)``
    (spans overlapping one block).  No per-file window and no alert × function
    pairs: a file holding a third of all alerts spreads over its blocks, and a
    single hot block is a skewed equi-join key that AQE splits.  The innermost
    span is the containing one that starts last (definitions nest)."""
    spans = analysis.select("file_path", F.explode("function_spans").alias("s")).select(
        "file_path", F.col("s.name").alias("fn"), F.col("s.start_line").alias("s0"), F.col("s.end_line").alias("s1"))
    blocks = spans.select("*", F.explode(F.sequence(F.floor(F.col("s0") / bucket).cast("int"),
                                                    F.floor(F.col("s1") / bucket).cast("int"))).alias("blk"))
    a = alerts.select("alert_id", "file_path", "line_number",
                      F.floor(F.col("line_number") / bucket).cast("int").alias("blk"))
    hits = (a.join(blocks, ["file_path", "blk"])
             .where(F.col("line_number").between(F.col("s0"), F.col("s1")))
             .groupBy("alert_id").agg(F.max_by("fn", F.struct("s0", "s1")).alias("enclosing_function")))
    return alerts.join(hits, "alert_id", "left")
