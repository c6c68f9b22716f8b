"""Searches over the analysis table.

Every search is a DataFrame expression: predicates push into the Parquet scan
of the stored table (nested ``metrics.average_complexity`` included), and an
ordered ``limit`` plans as TakeOrderedAndProject (each task keeps only k rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def get_result(analysis: DataFrame, file_path: str) -> DataFrame:
    """Point lookup by key."""
    return analysis.where(F.col("file_path") == F.lit(file_path))


def search_results(analysis: DataFrame, language: str | None = None, file_path_pattern: str | None = None,
                   min_complexity: float | None = None, max_complexity: float | None = None,
                   limit: int | None = None, literal: bool = False) -> DataFrame:
    """P5: optional conjunctive filters, newest first (ties by file_path).

    ``file_path_pattern`` is an ILIKE substring; like the reference, ``%``/``_``
    in it act as wildcards unless ``literal=True``."""
    preds = []
    if language is not None:
        preds.append(F.col("language") == F.lit(language))
    if file_path_pattern is not None:
        if literal:
            preds.append(F.lower("file_path").contains(file_path_pattern.lower()))
        else:
            preds.append(F.col("file_path").ilike(f"%{file_path_pattern}%"))
    avg = F.col("metrics.average_complexity")
    if min_complexity is not None:
        preds.append(avg >= F.lit(float(min_complexity)))
    if max_complexity is not None:
        preds.append(avg <= F.lit(float(max_complexity)))
    out = analysis.where(reduce(lambda a, b: a & b, preds)) if preds else analysis
    out = out.orderBy(F.col("created_at").desc(), F.col("file_path"))
    return out.limit(limit) if limit is not None else out


LISTS = {"functions": schemas.FUNCTION, "classes": schemas.CLASS, "structs": schemas.STRUCT, "imports": schemas.IMPORT}


def response(analysis: DataFrame) -> DataFrame:
    """P10: the typed record a search answers with: missing lists are empty,
    missing counts zero; parser_used and error may be null."""
    lists = [F.coalesce(F.col(c), F.array().cast(F.ArrayType(t))).alias(c) for c, t in LISTS.items()]
    metrics = F.struct(*[F.coalesce(F.col(f"metrics.{f.name}"), F.lit(0).cast(f.dataType)).alias(f.name)
                         for f in analysis.schema["metrics"].dataType.fields])
    return analysis.select("file_path", "language", *lists, metrics.alias("metrics"),
                           F.coalesce("has_errors", F.lit(False)).alias("has_errors"), "parser_used", "error")


def complexity_range(analysis: DataFrame, min_complexity: float | None = None,
                     max_complexity: float | None = None, top_k: int | None = None) -> DataFrame:
    """Inclusive band (NULL bounds default to 0 / 100), highest first, with
    ``complexity_score``."""
    lo = 0.0 if min_complexity is None else float(min_complexity)
    hi = 100.0 if max_complexity is None else float(max_complexity)
    avg = F.col("metrics.average_complexity")
    out = (analysis.where(avg.between(lo, hi)).withColumn("complexity_score", avg)
                   .orderBy(F.col("complexity_score").desc(), F.col("file_path")))
    return out.limit(top_k) if top_k is not None else out


def function_name_search(analysis: DataFrame, name: str, top_k: int = 5) -> DataFrame:
    """Case-insensitive substring over function names, one row per matching
    function, first k in (file_path, position) order, with ``matched_function``
    (its name and position).  Over a stored table only the flat heads are read."""
    needle = name.lower()
    stored = "function_heads" in analysis.columns            # names and places without bodies
    heads = F.col("function_heads") if stored else F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["position"].alias("position")))
    hits = analysis.select("*", F.explode(F.filter(heads, lambda f: F.lower(f["name"]).contains(needle))).alias("matched_function"))
    return hits.orderBy("file_path", "matched_function.position.start_line",
                        "matched_function.position.start_column").limit(top_k)


def language_filter(results: DataFrame, language: str | None, column: str = "language") -> DataFrame:
    """The language filter (applied after ranking in ``post`` mode)."""
    return results if language is None else results.where(F.col(column) == F.lit(language))


def search_code(analysis: DataFrame, vectors: DataFrame | None, query: str, search_type: str = "semantic",
                top_k: int = 5, language_filter_value: str | None = None, min_complexity: float | None = None,
                max_complexity: float | None = None, embed=None) -> DataFrame:
    """Dispatch by ``search_type``; an unknown type is an error."""
    if search_type == "semantic":
        from .vectors import topk_single
        if vectors is None or embed is None:
            raise ValueError("semantic search needs an index and an embedding function")
        res = topk_single(vectors, embed(query), top_k, id_col="file_path")
    elif search_type == "function_name":
        res = function_name_search(analysis, query, top_k)
    elif search_type == "complexity":
        res = complexity_range(analysis, min_complexity, max_complexity, top_k)
    else:
        raise ValueError(f"Invalid search type: {search_type}")
    return language_filter(res, language_filter_value)
