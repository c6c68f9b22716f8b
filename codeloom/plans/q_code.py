"""Corpus-level plans: line metrics and language distribution over ``code``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lines import line_metric_cols
from ..sources.corpus import code_files, duck_code_cte
from .registry import register

W = f"WITH {duck_code_cte()} "


@register("line_metrics", W + """
SELECT file_path, language,
  CAST(CASE id % 3 WHEN 0 THEN 14 + 2 * k WHEN 1 THEN 17 + k ELSE 15 + k END AS INTEGER) AS total_lines,
  CAST(CASE id % 3 WHEN 0 THEN 10 + 2 * k WHEN 1 THEN 11 + k ELSE 11 + k END AS INTEGER) AS code_lines,
  CAST(CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS comment_lines,
  CAST(CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS INTEGER) AS blank_lines
FROM code""")
def line_metrics(spark, sf_dir):
    """M1–M4 per file; the oracle is the closed form of the templates."""
    files = code_files(spark, sf_dir)
    m = line_metric_cols(F.col("content"), F.col("language"))
    return files.select("file_path", "language", *[c.alias(n) for n, c in m.items()])


@register("language_distribution", W + """
SELECT language, count(*) AS count, CAST(sum(CASE id % 3 WHEN 0 THEN 14 + 2 * k WHEN 1 THEN 17 + k
  ELSE 15 + k END) AS BIGINT) AS total_lines FROM code GROUP BY language""")
def language_distribution(spark, sf_dir):
    """A4: files and lines per language (partial aggregation before the shuffle)."""
    files = code_files(spark, sf_dir)
    m = line_metric_cols(F.col("content"), F.col("language"))
    return (files.select("language", m["total_lines"].alias("tl"))
                 .groupBy("language")
                 .agg(F.count(F.lit(1)).alias("count"), F.sum("tl").alias("total_lines")))
