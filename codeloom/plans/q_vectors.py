"""V2, V4–V7, S8, S9, A7 over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import vector_blocks as VB
from ..operators import vectors as V
from ..session import scratch_path
from ..sources.tables import read_table
from .registry import register

DIM = 64


def _index(spark, sf_dir, metric="ip"):
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return V.build_index(emb, DIM, metric=metric)


def _query_vec(spark, sf_dir):
    """The query vector: the embedding with the lowest id (64 floats to the driver)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.orderBy("vec_id").select("embedding").first()[0]


DUCK_IP = ("list_sum(list_transform(range(1, len(a) + 1), "
           "lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))")


def _duck_ip(a, b):
    return DUCK_IP.replace("a[i]", f"{a}[i]").replace("b[i]", f"{b}[i]").replace("len(a)", f"len({a})")


@register("semantic_topk", f"""
WITH q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, {_duck_ip('embedding', 'qe')} AS sc FROM embeddings, q)
SELECT CAST(row_number() OVER (ORDER BY round(sc, 12) DESC, vec_id) AS INTEGER) AS rank, vec_id AS id,
  round(sc, 6) AS similarity_score FROM s ORDER BY round(sc, 12) DESC, vec_id LIMIT 5""")
def semantic_topk(spark, sf_dir):
    """V5: exact inner-product top-5 for one query vector."""
    top = V.topk_single(_index(spark, sf_dir), _query_vec(spark, sf_dir), 5)
    return top.select("rank", "id", F.round("similarity_score", 6).alias("similarity_score"))


@register("semantic_topk_blocks", f"""
WITH q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, {_duck_ip('embedding', 'qe')} AS sc FROM embeddings, q)
SELECT CAST(row_number() OVER (ORDER BY round(sc, 12) DESC, vec_id) AS INTEGER) AS rank, vec_id AS id,
  round(sc, 6) AS similarity_score FROM s ORDER BY round(sc, 12) DESC, vec_id LIMIT 5""")
def semantic_topk_blocks(spark, sf_dir):
    """V5 over the blocked index: blocks whose bound cannot reach the k-th score
    are not read; the result is that of the full scan."""
    path = scratch_path(spark, "vector_blocks")
    VB.build(_index(spark, sf_dir), path, DIM, per_block=128)
    top, _ = VB.topk(spark, path, _query_vec(spark, sf_dir), 5)
    return top.select("rank", "id", F.round("similarity_score", 6).alias("similarity_score"))


@register("cosine_topk", f"""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x / sqrt({_duck_ip('embedding', 'embedding')}) AS FLOAT)) AS e
           FROM embeddings),
q AS (SELECT e AS qe FROM n ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, {_duck_ip('e', 'qe')} AS sc FROM n, q)
SELECT CAST(row_number() OVER (ORDER BY round(sc, 12) DESC, vec_id) AS INTEGER) AS rank, vec_id AS id,
  round(sc, 6) AS similarity_score FROM s ORDER BY round(sc, 12) DESC, vec_id LIMIT 5""")
def cosine_topk(spark, sf_dir):
    """V7: cosine = inner product over vectors normalised at build time."""
    idx = _index(spark, sf_dir, metric="cosine")
    q = idx.orderBy("id").select("embedding").first()[0]
    top = V.topk_single(idx, q, 5)
    return top.select("rank", "id", F.round("similarity_score", 6).alias("similarity_score"))


@register("semantic_topk_batch", f"""
WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {_duck_ip('v.embedding', 'q.embedding')} AS sc
           FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT qid, id, sc, row_number() OVER (PARTITION BY qid ORDER BY round(sc, 12) DESC, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(sc, 6) AS similarity_score FROM r WHERE rank <= 5""")
def semantic_topk_batch(spark, sf_dir):
    """V6: the stated query set, every vector whose id is divisible by 50,
    against all vectors (exact top-5)."""
    idx = _index(spark, sf_dir)
    qs = idx.where(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), "embedding")
    res = V.topk_batch(spark, qs, idx, 5, dim=DIM)
    return res.select("qid", "id", F.col("rank").cast("int").alias("rank"),
                      F.round("similarity_score", 6).alias("similarity_score"))


@register("vector_index_build", f"""
SELECT vec_id AS id, label, CAST(len(embedding) AS INTEGER) AS dim,
  round(sqrt({_duck_ip('embedding', 'embedding')}), 6) AS norm FROM embeddings""")
def vector_index_build(spark, sf_dir):
    """V4: build with dimension enforcement."""
    idx = _index(spark, sf_dir)
    return idx.select("id", "label", F.size("embedding").alias("dim"),
                      F.round(F.sqrt(V.inner_product(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@register("vector_save_load", """
SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS checksum
FROM embeddings""")
def vector_save_load(spark, sf_dir):
    """S8 + S9: save the index, load it back by schema."""
    path = scratch_path(spark, "vector_index")
    V.save_index(_index(spark, sf_dir), path)
    back = V.load_index(spark, path, schemas.VECTORS)
    return back.select("id", "label", F.round(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                                          lambda a, x: a + x.cast("double")), 6).alias("checksum"))


@register("vector_load_missing", "SELECT vec_id AS id, label, CAST(0 AS BIGINT) AS n_found FROM embeddings")
def vector_load_missing(spark, sf_dir):
    """An index that was never saved loads as an empty one of the same
    schema; every stored vector looks itself up in it and finds nothing."""
    missing = V.load_index(spark, scratch_path(spark, "missing_index"), schemas.VECTORS)
    found = missing.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return _index(spark, sf_dir).join(found, "id", "left").select("id", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n_found"))


@register("vector_upsert", f"""
SELECT vec_id AS id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label,
  round(sqrt({_duck_ip('embedding', 'embedding')}) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS norm FROM embeddings
UNION ALL SELECT vec_id + 1000000000, CAST(label AS BIGINT), round(sqrt({_duck_ip('embedding', 'embedding')}), 6) FROM embeddings WHERE vec_id % 7 = 0""")
def vector_upsert(spark, sf_dir):
    """V4 upsert: a third of the vectors replaced, some new ones added."""
    idx = _index(spark, sf_dir).select("id", "embedding", F.col("label").cast("long").alias("label"))
    twice = F.transform("embedding", lambda x: (x * 2).cast("float"))
    put = idx.where("id % 3 = 0").select("id", twice.alias("embedding"), (F.col("label") + 100).alias("label"))
    new = idx.where("id % 7 = 0").select((F.col("id") + 1000000000).alias("id"), "embedding", "label")
    now = V.upsert_index(idx, put.unionByName(new))
    return now.select("id", "label", F.round(F.sqrt(V.inner_product(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


@register("vector_stats", """
SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, 'exact_ip' AS index_type,
  count(vec_id) AS metadata_count FROM embeddings""")
def vector_stats(spark, sf_dir):
    """A7."""
    return V.index_stats(_index(spark, sf_dir))


@register("hash_embed", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS tok FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS n
      FROM t GROUP BY 1, 2),
z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM b GROUP BY 1)
SELECT doc_id, bucket, round(n / z, 6) AS weight FROM b JOIN z USING (doc_id)""")
def hash_embed(spark, sf_dir):
    """V2 default: hashed bag-of-words embedding of every document (non-zeros)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sp = V.hash_embed_sparse(docs, "doc_id", "text", DIM)
    return sp.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@register("sql_functions", f"""
SELECT vec_id AS id, round({_duck_ip('embedding', 'embedding')}, 6) AS self_product,
  CASE vec_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'java' END AS language FROM embeddings""")
def sql_functions(spark, sf_dir):
    """The registered SQL functions in a query over ``embeddings``."""
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark)
    read_table(spark, sf_dir, "embeddings").createOrReplaceTempView("codeloom_embeddings")
    return spark.sql("""SELECT vec_id AS id, round(inner_product(embedding, embedding), 6) AS self_product,
      lang_of(concat('/x/f', vec_id, CASE vec_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.golang' WHEN 2 THEN '.java' ELSE '.txt' END)) AS language
      FROM codeloom_embeddings""")
