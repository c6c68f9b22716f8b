"""R1–R5 as Structured Streaming queries.

* R1 ingest: file source → L1 normalisation → Parquet append (checkpointed).
* R3 idempotent retries: ``withWatermark`` + ``dropDuplicatesWithinWatermark``
  on the deterministic alert id, so a replayed file adds nothing within the
  watermark; ``alert_ingest_once`` has no such limit.
* R2 enrichment: ranking windows are not allowed on a stream, so each
  micro-batch runs the batch top-k (V6) inside ``foreachBatch``.
* R4 continuous analysis: manifests arrive as files; each micro-batch runs the
  extraction and appends records to the analysis log, or folds them into the
  versioned table (``continuous_table``), rewriting the key buckets it touches.
* R5 rolling activity: sliding ``window(ts, '24 hours', '1 hour')`` counts with
  a watermark, append mode (a window is emitted once it can no longer change).

Checkpoint locations must be on shared storage; callers pass them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.alerts import normalise
from ..operators.vectors import _path_exists
from ..session import materialize


def alert_ingest(spark: SparkSession, src_dir: str, schema: StructType, sink: str, checkpoint: str,
                 watermark: str = "24 hours"):
    """R1 + R3.  ``src_dir`` holds raw alert files (schema of ``raw_alerts``)."""
    raw = spark.readStream.schema(schema).parquet(src_dir)
    # Watermarks need TIMESTAMP (with zone); the table keeps TIMESTAMP_NTZ.
    out = (normalise(raw).withColumn("__et", F.col("created_at").cast("timestamp"))
           .withWatermark("__et", watermark).dropDuplicatesWithinWatermark(["alert_id"]).drop("__et"))
    return (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())


def alert_ingest_once(spark: SparkSession, src_dir: str, schema: StructType, sink: str, checkpoint: str, buckets: int = 64):
    """R1 + R3 without a time limit: an alert that the sink holds already, however
    old, is not added again.  The sink is partitioned by a hash of the alert id; a
    micro-batch reads the ids of the buckets that its own ids fall into and leaves
    those out.  A batch that is run again replaces what it had written."""
    def run(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        new = materialize(normalise(batch).dropDuplicates(["alert_id"]).withColumn("bucket", F.pmod(F.xxhash64("alert_id"), F.lit(buckets)).cast("int")), "alert-batch")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]      # at most ``buckets``
        if _path_exists(s, sink):
            held = s.read.option("basePath", sink).parquet(sink).where(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id)).select("alert_id")
            new = new.join(held, "alert_id", "left_anti")
        if touched:
            new.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    raw = spark.readStream.schema(schema).parquet(src_dir)
    return raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_activity(events: DataFrame, ts: str = "ts", length: str = "24 hours", slide: str = "1 hour",
                     watermark: str = "24 hours") -> DataFrame:
    """R5 (works on a stream or a batch frame)."""
    ev = events.withColumn("__et", F.col(ts).cast("timestamp"))  # event time must be TIMESTAMP
    # Events are counted per slide first; only these few rows go to all the
    # windows that hold them (window bounds are multiples of the slide).
    per_slide = (ev.withWatermark("__et", watermark).groupBy(F.window("__et", slide).alias("slide"))
                   .agg(F.count(F.lit(1)).alias("n")))
    w = F.window(F.window_time("slide"), length, slide)
    return (per_slide.groupBy(w.alias("window"))
              .agg(F.sum("n").alias("n_events"))
              .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"), "n_events"))


def rolling_activity_stream(spark: SparkSession, src_dir: str, schema: StructType, sink: str, checkpoint: str):
    ev = spark.readStream.schema(schema).parquet(src_dir)
    return (rolling_activity(ev).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def _write_batch(rows: DataFrame, sink: str, batch_id: int) -> None:
    """A folder per micro-batch (read back as column ``batch_id``): a batch that
    is run again after a failure replaces what it had written."""
    rows.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")


def alert_enrichment(spark: SparkSession, src_dir: str, schema: StructType, vectors: DataFrame, embed_fn,
                     sink: str, checkpoint: str, k: int = 5, dim: int = 64):
    """R2: stream–static top-k per micro-batch (``foreachBatch``)."""
    from ..operators import alerts as A
    from ..operators import vectors as V

    def run(batch: DataFrame, batch_id: int) -> None:
        al = A.alert_text(normalise(batch)).persist()
        try:
            qv = embed_fn(al.select("query_text").distinct(), "query_text", "query_text", dim)
            top = V.topk_batch(batch.sparkSession, qv, vectors, k, qid_col="query_text")
            res = (top.withColumnRenamed("qid", "query_text").join(al.select("alert_id", "query_text"), "query_text")
                      .select("alert_id", "rank", F.col("id").alias("vector_id"), "similarity_score"))
            _write_batch(res, sink, batch_id)
        finally:
            al.unpersist()

    raw = spark.readStream.schema(schema).parquet(src_dir)
    return (raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def analysis_log(records: DataFrame, ts, seq: int) -> DataFrame:
    """Records as ``put`` rows of the change log that T1's fold reads."""
    return records.withColumns({"op": F.lit("put"), "ts": ts, "seq": F.lit(seq).cast("long"), "created_hint": ts})


def continuous_analysis(spark: SparkSession, src_dir: str, schema: StructType, sink: str, checkpoint: str):
    """files(file_path, language, content) arriving as Parquet → analysis log."""
    from ..operators.analysis import analyse

    def run(batch: DataFrame, batch_id: int) -> None:
        rec = analyse(batch.select("file_path", "language", "content"))
        _write_batch(analysis_log(rec, F.current_timestamp().cast("timestamp_ntz"), batch_id), sink, batch_id)

    raw = spark.readStream.schema(schema).parquet(src_dir)
    return (raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def continuous_table(spark: SparkSession, src_dir: str, schema: StructType, table: str, checkpoint: str, buckets: int = 64):
    """R4 + T1: files(file_path, language, content, op, ts, seq) arriving as Parquet,
    analysed and folded into the snapshot table ``table``.  ``op`` is put or delete;
    a batch that is run again after a failure finds itself committed or starts over."""
    from ..operators import snapshots
    from ..operators.analysis import analyse, with_flat_columns

    def run(batch: DataFrame, batch_id: int) -> None:
        # of a file that comes several times in a batch, its latest content counts
        last = batch.groupBy("file_path").agg(F.max_by(F.struct("language", "content", "op", "ts", "seq"), F.struct("ts", "seq")).alias("r")).select("file_path", "r.*")
        rec = with_flat_columns(analyse(last.where("op = 'put'").select("file_path", "language", "content")))
        payload = [c for c in rec.columns if c != "file_path"]
        log = last.select("file_path", "op", "ts", "seq", F.col("ts").alias("created_hint")).join(rec, "file_path", "left")
        snapshots.apply_log(batch.sparkSession, table, log, "file_path", payload, [], batch_id, buckets=buckets)

    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src_dir)
    return (raw.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
