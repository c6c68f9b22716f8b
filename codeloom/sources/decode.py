"""S5 decode policy for raw file bytes.

Python/Go: strict UTF-8 — invalid files go to a ``rejects`` frame (never call
``decode(..., 'UTF-8')`` unguarded: it raises on bad bytes).  Java: UTF-8 when
valid, else ISO-8859-1 (which always succeeds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def decode_policy(language: Column, raw: Column) -> Column:
    """Decoded text, or NULL when the language's policy rejects the bytes."""
    ok = is_valid_utf8(raw)
    return (F.when(ok, raw.cast("string"))
             .when(language == "java", F.decode(raw, "ISO-8859-1"))
             .otherwise(F.lit(None).cast("string")))


def split_accepted(files: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    d = files.withColumn("content", decode_policy(F.col("language"), F.col(raw_col)))
    return (d.where(F.col("content").isNotNull()).drop(raw_col),
            d.where(F.col("content").isNull()).drop("content")
             .withColumn("reason", F.lit("invalid utf-8")))
