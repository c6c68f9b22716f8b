"""Session helpers: sane defaults for tests, and a checkpoint folder taken from
the session (``spark.checkpoint.dir``) so lineage cuts land on shared storage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Broadcast only small, checked sides; the threshold is the safety net for
    # the cases Catalyst picks on its own.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "codeloom",
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only when the
    session has none (local tests).  On a cluster the setting names shared
    storage and is always respected."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="codeloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df, name: str = "stage", bucket_by: str | None = None, buckets: int | None = None, partition_by: tuple[str, ...] = ()):
    """Cut lineage: write ``df`` once as a Parquet table under
    ``spark.checkpoint.dir`` (shared storage on a cluster) and read it back.

    A lost executor then re-reads files instead of recomputing the token
    windows, several consumers share one computation, and (unlike
    ``Dataset.checkpoint``) the input is computed once, stored columnar and
    compressed, and read back with the vectorised reader.  A bucketed table may
    have folders by ``partition_by`` (few values), so that a filter on them reads
    its own files only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    # Bucketed by the key every consumer partitions on: reads come back
    # hash-partitioned, so later windows/joins on the key need no exchange.
    import uuid

    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"codeloom_{name}_{uuid.uuid4().hex[:12]}"
    # A task holds one bucket or few: it keeps a writer for each open instead of
    # sorting its rows by bucket, which would spill them all.
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
    w = df.write.mode("overwrite").bucketBy(n, bucket_by).option("path", path)
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(table)
    # Its size on disk says little of its rows (names and small numbers compress
    # well): by that size a join would collect millions of them for a broadcast.
    return spark.table(table).hint("merge")
