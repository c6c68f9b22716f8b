"""Substring and vector indexes: the same rows as the scans, less read."""

import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import search as S
from codeloom.operators import substring_index as SI
from codeloom.operators import vector_blocks as VB
from codeloom.operators import vectors as V
from tests.conftest import SF_SMALL


def _stored(spark, path, n=400):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        names = [rnd.choice(["get", "set", "Load", "Straße", "x"]) + rnd.choice(["User", "Item", "_all", ""]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(4))]
        rows.append((f"/src/m{i % 7}/f_{i}.py", names))
    heads = F.transform("names", lambda x: F.struct(x.alias("name"), F.struct(F.lit(1).alias("start_line"), F.lit(0).alias("start_column")).alias("position")))
    df = spark.createDataFrame(rows, "file_path string, names array<string>").select("file_path", heads.alias("function_heads"), F.lit("python").alias("language"),
                                                                                   F.lit(None).cast("timestamp_ntz").alias("created_at"))
    df.repartitionByRange(8, "file_path").sortWithinPartitions("file_path").write.parquet(path)
    return spark.read.parquet(path)


def test_names_and_paths_by_grams(spark, tmp_path):
    a = _stored(spark, str(tmp_path / "a"))
    SI.build(a.select("file_path", F.explode("function_heads.name").alias("text")), str(tmp_path / "n"))
    SI.build(a.select("file_path", F.col("file_path").alias("text")), str(tmp_path / "p"))
    key = lambda df: [(r.file_path, r.matched_function.name) for r in df.collect()]
    for needle in ("USER4", "tUser49", "raße1", "load", "_all33", "nothere", "zz", "x", "", "getUser7", "%er"):
        assert key(SI.function_name_search(a, str(tmp_path / "n"), needle, 1000)) == key(S.function_name_search(a, needle, 1000)), needle
    for part in ("F_39", "m3/f_1", ".py", "/src/M6", "nope", "f_", "_"):
        got = [r.file_path for r in SI.path_search(a, str(tmp_path / "p"), part).collect()]
        assert got == [r.file_path for r in S.search_results(a, file_path_pattern=part, literal=True).collect()], part


def test_a_selective_search_reads_few_folders(spark, tmp_path):
    a = _stored(spark, str(tmp_path / "a"))
    SI.build(a.select("file_path", F.explode("function_heads.name").alias("text")), str(tmp_path / "n"))
    needle = a.select(F.explode("function_heads.name").alias("x")).where("x rlike 'User[0-9]{2}'").first()["x"]
    hits = SI.candidates(spark, str(tmp_path / "n"), needle)
    from tests.test_plans import _plan
    filters = [line for line in _plan(hits).splitlines() if "PartitionFilters" in line]
    assert filters and all("part" in line.split("PartitionFilters")[1] for line in filters)
    folders = {r["f"].split("part=")[1].split("/")[0] for r in spark.read.parquet(f"{tmp_path}/n/postings").where(F.col("part").isin([1, 2, 3])).select(F.input_file_name().alias("f")).distinct().collect()}
    assert folders <= {"1", "2", "3"} and 0 < hits.count() < 40


def test_blocked_topk_equals_the_scan(spark, tmp_path):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    VB.build(emb, str(tmp_path / "b"), 64, per_block=20)
    for q in emb.orderBy("id").limit(4).collect():
        top, _ = VB.topk(spark, str(tmp_path / "b"), q.embedding, 7)
        want = V.topk_single(emb, q.embedding, 7)
        assert [(r.rank, r.id, r.similarity_score) for r in top.orderBy("rank").collect()] == [(r.rank, r.id, r.similarity_score) for r in want.orderBy("rank").collect()]


def test_blocked_topk_reads_few_blocks_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16)) * 5
    rows = [(i, (centres[i % 12] + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(5000 + i, rows[3][1]) for i in range(9)]                       # ties
    emb = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    VB.build(emb, str(tmp_path / "b"), 16, per_block=40)
    n = spark.read.parquet(str(tmp_path / "b/blocks")).count()
    for q in (rows[3][1], rows[40][1], [0.0] * 16):
        top, read = VB.topk(spark, str(tmp_path / "b"), q, 5)
        assert [(r.id, r.similarity_score) for r in top.orderBy("rank").collect()] == [(r.id, r.similarity_score) for r in V.topk_single(emb, q, 5).orderBy("rank").collect()]
        assert len(read) < n / 2 or not any(q)
    VB.build(emb.limit(0), str(tmp_path / "e"), 16)
    assert VB.topk(spark, str(tmp_path / "e"), rows[0][1], 5)[1] == []


def test_alerts_replayed_after_any_time_add_nothing(spark, tmp_path):
    from codeloom.sources.alerts_src import raw_alerts
    from codeloom.streaming import jobs
    raw = raw_alerts(spark, SF_SMALL).limit(60)
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.alert_ingest_once(spark, src, raw.schema, sink, ck).awaitTermination()
        return spark.read.parquet(sink).select("alert_id")
    late = [f.name for f in raw.schema.fields if "time" in f.dataType.simpleString()]
    assert arrive(raw).count() == 60
    assert arrive(raw).count() == 60
    ids = arrive(raw.limit(10))
    assert ids.count() == ids.distinct().count() == 60 and late is not None


def test_vectors_without_an_id_stay(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)] + [(None, [4.0, 1.0]), (None, [9.0, 1.0])]
    emb = spark.createDataFrame(rows, "id long, embedding array<float>")
    qs = spark.createDataFrame([("a", [1.0, 0.0])], "qid string, embedding array<float>")
    got = [r.id for r in V.topk_batch(spark, qs, emb, 4, block=7).orderBy("rank").collect()]
    assert got == [r.id for r in V.topk_single(emb, [1.0, 0.0], 4).orderBy("rank").collect()] == [None, None, 4, 9]


def test_embedding_is_a_projection(spark):
    from tests.test_plans import _plan
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = _plan(V.hash_embed(docs, "doc_id", "text"), "simple")
    assert "Exchange" not in p and "Generate" not in p


def test_name_search_reads_no_bodies(spark):
    from codeloom.plans.q_extract import analysis_table
    from tests.test_plans import _plan
    r = S.function_name_search(analysis_table(spark, SF_SMALL), "run", 5)
    assert "body_text" not in _plan(r.select("file_path", "matched_function.name"))
