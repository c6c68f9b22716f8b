"""Exact vector index and search.

The index is one Parquet dataset ``(id, embedding ARRAY<FLOAT>, <metadata>)`` —
vectors and metadata cannot drift apart, identity is the id, not a position.

* single query (V5): score column + ``orderBy(desc).limit(k)`` →
  TakeOrderedAndProject: each task keeps k rows, the driver merges k×tasks.
* batch (V6): blocks of queries meet blocks of vectors in grouped tasks, each
  with one bounded score matrix that leaves k rows per query; a window
  ``row_number() <= k`` over ``qid`` (planned as WindowGroupLimit) merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

INDEX_TYPE = "exact_ip"
#: Rows of a block of the batch search; a task's score matrix has its square.
BLOCK_ROWS = 2048
#: Scores are ranked at this many decimals, so that sums that differ in their
#: last bits are ties (and go by id) in every path.
SCORE_DIGITS = 12


def inner_product(a: Column, b: Column) -> Column:
    """Σ a_i·b_i in double precision, folded in index order (stable sums)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_normalise(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))


def token_bucket(tok: Column, dim: int) -> Column:
    """md5 of the token, first 8 hex digits as an integer, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read (an
    expression that a lambda refers to would be computed anew for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket_weights(text: Column, dim: int) -> Column:
    """Counts of the text's tokens in ``dim`` buckets, divided by their norm (zeros
    without tokens), as an array and within the row: the buckets are sorted with
    one sentinel for each number, and the distance of two sentinels is the count
    between them."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\w+"), 0)
    numbers = F.array(*[F.lit(i) for i in range(dim + 1)])
    marked = F.array_sort(F.concat(F.transform(toks, lambda t: token_bucket(t, dim)), numbers))
    places = _let(marked, lambda m: F.transform(numbers, lambda i: F.array_position(m, i)))
    counts = _let(places, lambda p: F.zip_with(F.slice(p, 2, dim), F.slice(p, 1, dim), lambda after, at: after - at - 1))

    def normed(c):
        norm = F.sqrt(F.aggregate(c, F.lit(0).cast("long"), lambda acc, n: acc + n * n).cast("double"))
        return _let(norm, lambda z: F.transform(c, lambda n: F.when(z > 0, n / z).otherwise(F.lit(0.0))))
    return _let(counts, normed)


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """V2 default model: hashed bag of lowercase ``\\w+`` tokens, L2-normalised.

    Returns the non-zero entries ``(id, bucket, weight)``, at most ``dim`` a row."""
    return df.select(id_col, F.posexplode(bucket_weights(F.col(text_col), dim)).alias("bucket", "weight")).where("weight > 0")


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """Dense form ``(id, embedding ARRAY<FLOAT>)`` of :func:`hash_embed_sparse`, one
    row for each of ``df``; texts without tokens get a zero vector.  A plain
    projection: no row is multiplied, nothing is exchanged."""
    return df.select(id_col, bucket_weights(F.col(text_col), dim).cast("array<float>").alias("embedding"))


def build_index(vectors: DataFrame, dim: int, id_col: str = "id", emb_col: str = "embedding",
                metric: str = "ip") -> DataFrame:
    """V4/V7: enforce the dimension (the job fails on a wrong-size vector, as the
    index build does) and, for ``cosine``, normalise once at build time."""
    emb = F.col(emb_col)
    checked = F.when(F.size(emb) != dim,
                     F.raise_error(F.concat(F.lit("embedding dimension mismatch for id "),
                                            F.col(id_col).cast("string")))).otherwise(emb)
    if metric == "cosine":
        checked = l2_normalise(checked)
    elif metric != "ip":
        raise ValueError(f"unknown metric {metric!r}")
    return vectors.withColumn(emb_col, checked.cast(ArrayType(FloatType())))


def upsert_index(index: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """V4 upsert mode: ``changes`` replace the vectors of equal id and add the
    others (columns as in ``index``, ids unique in either)."""
    return index.join(changes.select(id_col), id_col, "left_anti").unionByName(changes)


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet dataset holds vectors and metadata."""
    index.write.mode(mode).parquet(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_index(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A missing index is an empty one; a corrupt one raises."""
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def empty_index(spark: SparkSession, schema: StructType, path: str | None = None) -> DataFrame:
    """Create / clear = overwrite with a 0-row dataset of the schema."""
    df = spark.createDataFrame([], schema)
    if path:
        df.write.mode("overwrite").parquet(path)
    return df


def index_stats(index: DataFrame, id_col: str = "id", emb_col: str = "embedding") -> DataFrame:
    """Total vectors, dimension, type, metadata count (one aggregate)."""
    return index.agg(F.count(F.lit(1)).alias("total_vectors"),
                     F.coalesce(F.max(F.size(emb_col)), F.lit(0)).alias("dimension"),
                     F.lit(INDEX_TYPE).alias("index_type"),
                     F.count(id_col).alias("metadata_count"))


def topk_single(index: DataFrame, query_vec: list[float], k: int = 5, id_col: str = "id",
                emb_col: str = "embedding") -> DataFrame:
    """V5: exact top-k for one query; k = min(top_k, n) falls out of ``limit``.
    Ties are broken by id.  Adds ``similarity_score`` and 1-based ``rank``."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query_vec])
    scored = index.withColumn("similarity_score", F.round(inner_product(F.col(emb_col), q), SCORE_DIGITS))
    top = scored.orderBy(F.col("similarity_score").desc(), F.col(id_col)).limit(k)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("similarity_score").desc(), F.col(id_col))))


def _block_topk(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query row: positions and scores of its first k vectors by
    (score desc, id asc); ``ids`` are the positions in the order of the ids.  A matrix product finds all vectors that may be among
    them; their scores are then summed in index order, as the single-query path
    does, and rounded alike."""
    order = ids                                                # ties go by id
    rough = q @ v[order].T
    k = min(k, rough.shape[1])
    bound = 1e-9 * (1 + np.abs(rough).max(initial=0))
    kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(rough >= kth[:, None] - bound)
    exact = np.zeros(len(row))
    for d in range(q.shape[1]):
        exact += q[row, d] * v[order[col], d]
    exact = np.round(exact, SCORE_DIGITS)
    best = np.lexsort((col, -exact, row))
    row, col, exact = row[best], col[best], exact[best]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    return np.stack([row[top], order[col[top]]]), exact[top]


def topk_batch(spark: SparkSession, queries: DataFrame, index: DataFrame, k: int = 5,
               qid_col: str = "qid", qemb_col: str = "embedding", id_col: str = "id",
               emb_col: str = "embedding", dim: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """V6: exact top-k for every query row: (qid, id, similarity_score, rank).

    Both sides are dealt into blocks of about ``block`` rows.  Each block of
    queries meets each block of vectors in one grouped task: its score matrix
    has ``block`` squared entries, whatever the size of either side, and it
    emits k rows per query.  A window over the query id, limited map-side,
    merges the blocks' candidates.  Nothing passes through the driver but two
    counts; ids keep their type, and a vector without an id comes first among
    equals.  Ties: score (rounded) desc, id asc."""
    nq, nv = max(1, -(-queries.count() // block)), max(1, -(-index.count() // block))
    q = queries.select(F.col(qid_col).alias("qid"), F.col(qemb_col).alias("e"))
    v = index.select(F.col(id_col).alias("id"), F.col(emb_col).alias("e"))
    qt, vt = q.schema["qid"].dataType, v.schema["id"].dataType
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    ql = q.select(F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"), every(nv, "vb"), F.lit(True).alias("is_query"), "qid", F.lit(None).cast(vt).alias("id"), "e")
    vl = v.select(every(nq, "qb"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vb"), F.lit(False).alias("is_query"), F.lit(None).cast(qt).alias("qid"), "id", "e")
    out = StructType([StructField("qid", qt), StructField("id", vt), StructField("similarity_score", DoubleType())])

    def meet(t: pa.Table) -> pa.Table:
        is_q = np.asarray(t.column("is_query").to_numpy(), bool)
        at_q, at_v = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        empty = pa.table({"qid": t.column("qid").slice(0, 0), "id": t.column("id").slice(0, 0), "similarity_score": pa.array([], pa.float64())})
        if not len(at_q) or not len(at_v):
            return empty
        e = np.stack([np.asarray(x, dtype=np.float64) for x in t.column("e").to_numpy()])
        ids = t.column("id").take(pa.array(at_v))
        by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy().astype(np.int64)   # as Spark sorts
        pair, score = _block_topk(e[at_q], e[at_v], by_id, k)
        return pa.table({"qid": t.column("qid").take(pa.array(at_q[pair[0]])), "id": ids.take(pa.array(pair[1])), "similarity_score": pa.array(score)})

    cand = ql.unionByName(vl).groupBy("qb", "vb").applyInArrow(meet, out)
    w = Window.partitionBy("qid").orderBy(F.col("similarity_score").desc(), F.col("id"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def embed_text(spark: SparkSession, text: str, dim: int = 64) -> list[float]:
    """V3: embed one query string with the default model (a one-row DataFrame
    through :func:`hash_embed`; only the ``dim`` floats come back)."""
    df = spark.createDataFrame([(0, text)], "qid long, t string")
    return list(hash_embed(df, "qid", "t", dim).first()["embedding"])
