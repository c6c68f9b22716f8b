"""Language dimension (U1: a language is data, not a class) and resolution.

P1 resolve by name/alias (case-insensitive), P2 resolve by file suffix,
P3 listing / membership / info map.  The dimension is a handful of rows, so
joining it is always a broadcast of a bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted language names and aliases, each with its canonical
# language, default file pattern and line-comment prefix.
LANGUAGE_ROWS = [
    # alias,   language, pattern,  comment_prefix, parser
    ("python", "python", "*.py", "#", "PythonParser"),
    ("py", "python", "*.py", "#", "PythonParser"),
    ("go", "go", "*.go", "//", "GoParser"),
    ("golang", "go", "*.go", "//", "GoParser"),
    ("java", "java", "*.java", "//", "JavaParser"),
]

LANGUAGE_DIM_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" for v in r) + ")" for r in LANGUAGE_ROWS)
    + ") AS t(alias, language, pattern, comment_prefix, parser)")


def language_dim(spark: SparkSession, extra_rows: list[tuple] | None = None) -> DataFrame:
    """The alias → language table.  ``extra_rows`` adds a language by rows only."""
    rows = list(LANGUAGE_ROWS) + list(extra_rows or [])
    return spark.createDataFrame(rows, "alias string, language string, pattern string, "
                                       "comment_prefix string, parser string")


def file_suffix(path: Column) -> Column:
    """Last suffix of the file name, lowercased, without the dot.  A leading-dot
    name such as ``.bashrc`` has no suffix, as with the usual path libraries."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def resolve_language(df: DataFrame, key: Column, dim: DataFrame, out: str = "language") -> DataFrame:
    """Left join to the (tiny, broadcast) dimension on ``lower(key) = alias``;
    unknown keys resolve to NULL."""
    d = dim.select(F.col("alias").alias("__alias"), F.col("language").alias(out))
    return (df.withColumn("__key", F.lower(key))
              .join(F.broadcast(d), F.col("__key") == F.col("__alias"), "left")
              .drop("__key", "__alias"))


def resolve_by_extension(df: DataFrame, path_col: str, dim: DataFrame, out: str = "language") -> DataFrame:
    return resolve_language(df, file_suffix(F.col(path_col)), dim, out)


def supported_languages(dim: DataFrame) -> DataFrame:
    """The listing (aliases, as the reference lists them) plus the info map."""
    return dim.select("alias", "language", "parser")


def parser_info(dim: DataFrame) -> DataFrame:
    return dim.agg(F.map_from_entries(F.collect_list(F.struct("alias", "parser"))).alias("parsers"))


def is_supported(df: DataFrame, key: Column, dim: DataFrame) -> DataFrame:
    """Membership as a semi join against the dimension."""
    return (df.withColumn("__key", F.lower(key))
              .join(F.broadcast(dim.select(F.col("alias").alias("__key"))), "__key", "left_semi")
              .drop("__key"))
