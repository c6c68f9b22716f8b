"""V5: exact top-k over a blocked index that skips blocks by a bound.

``build`` deals the vectors to the nearest of a bounded number of seeds and writes a
folder for each block, with its centroid c and radius r.  No vector of a block has a
greater inner product with a query q than q·c + |q| r, so after the blocks of the
greatest bounds have given a k-th score, only blocks whose bound reaches it are read.
The result is that of the full scan, ties included: scores are the same rounded sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .vectors import topk_single

#: Vectors in a block, roughly, and blocks at most (their centroids go to the driver).
PER_BLOCK, MOST_BLOCKS = 2048, 4096
BLOCKS = "block int, n long, centroid array<double>, radius double"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _vectors(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored vectors; an empty index has no file to tell the schema."""
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def build(index: DataFrame, path: str, dim: int, id_col: str = "id", emb_col: str = "embedding", per_block: int = PER_BLOCK) -> None:
    """Write the blocks of ``index`` (vectors of ``dim`` floats, none null)."""
    spark = index.sparkSession
    n = min(MOST_BLOCKS, max(1, -(-index.count() // per_block)))
    seeds = np.array([r["e"] for r in index.select(F.col(emb_col).alias("e"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(n).collect()], float).reshape(-1, dim)
    norms = (seeds ** 2).sum(axis=1)

    names = [*index.columns, "block"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(b.num_columns - 1), dim)
            block = np.argmin(norms - 2 * v @ seeds.T, axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(block.astype(np.int32))], names=names)

    src = index.select("*", F.col(emb_col).alias("vector"))
    dealt = src.mapInArrow(deal, index.withColumn("block", F.lit(0)).schema)
    dealt.write.mode("overwrite").partitionBy("block").parquet(f"{path}/vectors")

    stored = _vectors(spark, path, dealt.schema).select("block", F.col(emb_col).alias("e"))

    def sums(batches):
        for b in batches:
            block, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for k in np.unique(block):
                at = block == k
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int(at.sum())]), pa.array([v[at].sum(axis=0).tolist()])], names=["block", "n", "total"])

    total: dict[int, tuple[int, np.ndarray]] = {}
    for r in stored.mapInArrow(sums, "block int, n long, total array<double>").toLocalIterator():
        m, t = total.get(r["block"], (0, np.zeros(dim)))
        total[r["block"]] = (m + r["n"], t + np.array(r["total"]))
    centre = {k: t / m for k, (m, t) in total.items()}

    def reach(batches):
        for b in batches:
            block, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for k in np.unique(block):
                far = np.sqrt(((v[block == k] - centre[int(k)]) ** 2).sum(axis=1)).max()
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([float(far)])], names=["block", "radius"])

    radius = {r["block"]: r["radius"] for r in stored.mapInArrow(reach, "block int, radius double").groupBy("block").agg(F.max("radius").alias("radius")).collect()}
    rows = [(k, total[k][0], centre[k].tolist(), radius[k]) for k in sorted(total)]
    spark.createDataFrame(rows, BLOCKS).coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")


def topk(spark: SparkSession, path: str, query_vec: list[float], k: int = 5, id_col: str = "id", emb_col: str = "embedding") -> tuple[DataFrame, list[int]]:
    """``vectors.topk_single``'s rows (with ``block``), and the blocks that were read."""
    q = np.asarray([np.float32(x) for x in query_vec], np.float64)
    stats = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").collect()      # MOST_BLOCKS at most
    bound = {r["block"]: float(np.dot(q, r["centroid"]) + np.linalg.norm(q) * r["radius"]) for r in stats}
    slack = 1e-9 * (1 + max(map(abs, bound.values()), default=0.0))
    best = sorted(bound, key=lambda b: -bound[b])
    first, held = [], 0
    sizes = {r["block"]: r["n"] for r in stats}
    for b in best:
        if held >= k:
            break
        first.append(b)
        held += sizes[b]
    vectors = spark.read.parquet(f"{path}/vectors") if stats else spark.createDataFrame([], f"{id_col} long, {emb_col} array<float>, block int")
    some = vectors.where(F.col("block").isin(first)) if first else vectors.limit(0)
    got = topk_single(some, query_vec, k, id_col, emb_col).agg(F.min("similarity_score").alias("s")).first()["s"]
    read = first if got is None or held < k else [b for b in best if b in first or bound[b] + slack >= got]
    return topk_single(vectors.where(F.col("block").isin(read)) if read else vectors.limit(0), query_vec, k, id_col, emb_col), read
