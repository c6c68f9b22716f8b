"""Streaming = batch via Trigger.AvailableNow; replayed alerts add nothing."""

from pyspark.sql import functions as F

from codeloom.sources.alerts_src import raw_alerts
from codeloom.streaming import jobs
from tests.conftest import SF_SMALL


def test_rolling_activity_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("ts")
    src = str(tmp_path / "src")
    ev.write.parquet(src)
    q = jobs.rolling_activity_stream(spark, src, ev.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = jobs.rolling_activity(ev)
    # Append mode only emits windows closed by the watermark.
    wm = ev.agg(F.max("ts")).first()[0]
    import datetime
    closed = batch.where(F.col("window_end") <= F.lit(wm - datetime.timedelta(hours=24)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_alert_ingest_is_idempotent(spark, tmp_path):
    raw = raw_alerts(spark, SF_SMALL)
    src = str(tmp_path / "src")
    raw.write.parquet(src)
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    jobs.alert_ingest(spark, src, raw.schema, sink, ck).awaitTermination()
    n1 = spark.read.parquet(sink).count()
    raw.write.mode("append").parquet(src)   # the same alerts again (a retry)
    jobs.alert_ingest(spark, src, raw.schema, sink, ck).awaitTermination()
    n2 = spark.read.parquet(sink).count()
    assert n1 == raw.count() and n2 == n1


def test_continuous_analysis_equals_batch(spark, tmp_path):
    from codeloom.operators.analysis import analyse
    from codeloom.sources.corpus import code_files
    files = code_files(spark, SF_SMALL).select("file_path", "language", "content")
    src = str(tmp_path / "manifests")
    files.write.parquet(src)
    q = jobs.continuous_analysis(spark, src, files.schema, str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "log"))
    exp = analyse(files)
    key = lambda df: sorted((r.file_path, r.n) for r in df.select("file_path", F.size("functions").alias("n")).collect())
    assert key(got) == key(exp)


def test_alert_enrichment_stream(spark, tmp_path):
    from codeloom.operators import vectors as V
    raw = raw_alerts(spark, SF_SMALL).limit(50)   # a small fixture stream
    src = str(tmp_path / "alerts")
    raw.write.parquet(src)
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = jobs.alert_enrichment(spark, src, raw.schema, emb, V.hash_embed, str(tmp_path / "out"),
                              str(tmp_path / "ck"), k=5, dim=64)
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    per = out.groupBy("alert_id").count().collect()
    assert len(per) == 50 and all(r["count"] == 5 for r in per)
