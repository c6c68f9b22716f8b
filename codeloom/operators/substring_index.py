"""Trigram posting lists for substring searches.

Beside a stored table, ``build`` writes which rows hold which trigrams of a lower-cased
text: postings ``(part, gram, file_path)``, partitioned by a hash of the gram and
sorted within, and how often each gram occurs.  A search reads the counts of its
needle's grams, then the postings of the rarest few of them, and verifies the text
of the rows that hold all of these.  So a selective search reads some folders of
postings and the rows it verifies, whatever the size of the table; the verification
makes it exact.  Needles of under three characters have no gram and scan.

A gram that all rows hold (``.py``) is the last to be picked; its list is spread
over as many files as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as S

PARTS = 64
#: Grams of a needle whose lists are read.
RAREST = 3
#: Candidate rows up to which their keys go into the scan's filter.
IN_FILTER = 1000


def grams(text: Column) -> Column:
    t = F.lower(text)
    n = F.length(t)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(t, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def build(entries: DataFrame, path: str) -> None:
    """Index ``entries`` (file_path, text; several texts for a file are fine)."""
    spark = entries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = entries.select("file_path", F.explode(grams(F.col("text"))).alias("gram")).distinct().withColumn("part", _part(F.col("gram")))
    p.repartitionByRange(n, "part", "gram", "file_path").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("part", "gram").agg(F.count("*").alias("n"))
    counts.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, needle: str, rarest: int = RAREST) -> DataFrame | None:
    """file_path of the rows that hold the needle's rarest grams; None: it has no
    gram, so every row may match."""
    low = needle.lower()
    own = sorted({low[i: i + 3] for i in range(len(low) - 2)})
    if not own:
        return None
    at = {r["gram"]: r["part"] for r in spark.createDataFrame([(g,) for g in own], "gram string").withColumn("part", _part(F.col("gram"))).collect()}
    counts = spark.read.schema("gram string, n long, part int").parquet(f"{path}/counts").where(F.col("part").isin(list(set(at.values()))) & F.col("gram").isin(own))
    n = {r["gram"]: r["n"] for r in counts.collect()}          # as many rows as the needle has grams
    postings = spark.read.schema("file_path string, gram string, part int").parquet(f"{path}/postings")
    if len(n) < len(own):                                      # a gram that no row holds
        return postings.limit(0).select("file_path")
    few = sorted(own, key=lambda g: n[g])[:rarest]
    hits = postings.where(F.col("part").isin([at[g] for g in few]) & F.col("gram").isin(few))
    return hits.groupBy("file_path").agg(F.count("*").alias("held")).where(F.col("held") == len(few)).select("file_path")


def _narrowed(analysis: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return analysis
    keys = [r["file_path"] for r in found.limit(IN_FILTER + 1).collect()]
    if len(keys) <= IN_FILTER:                                 # reaches the scan as a pushed filter
        return analysis.where(F.col("file_path").isin(keys)) if keys else analysis.limit(0)
    return analysis.join(found, "file_path", "left_semi")


def function_name_search(analysis: DataFrame, path: str, name: str, top_k: int = 5) -> DataFrame:
    """P9 through the index of function names."""
    return S.function_name_search(_narrowed(analysis, candidates(analysis.sparkSession, path, name)), name, top_k)


def path_search(analysis: DataFrame, path: str, part_of_path: str, **filters) -> DataFrame:
    """P5 with a literal substring through the index of paths."""
    found = candidates(analysis.sparkSession, path, part_of_path)
    return S.search_results(_narrowed(analysis, found), file_path_pattern=part_of_path, literal=True, **filters)
