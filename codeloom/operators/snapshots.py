"""T1 + T4 + R4: the analysis table as versioned snapshots, kept by key bucket.

A table is a folder of

* ``data/<id>/state/bucket=B``: rows of the change log that still decide bucket B:
  one ``snap`` row for each live key up to the bucket's cutoff, and the log rows
  from the cutoff on;
* ``data/<id>/current/bucket=B``: the fold of these rows, which readers scan;
* ``manifest/<version>.json``: for each bucket the data folder that holds it and
  its cutoff.  A version is made by renaming a finished manifest into place, all
  buckets at once; readers take the highest version.

A batch of log rows rewrites the buckets it touches, from their stored rows and
its own, and nothing else.  A writer that dies before the rename leaves a folder
that no manifest names: the table is as before, the batch can be run again, and
``vacuum`` removes the rest.  A batch that was committed already (``batch_id``)
changes nothing.

Rows may come in any order within ``late_by`` of the latest time seen in their
bucket; what is older than a bucket's cutoff can no longer be folded exactly and
goes to ``late/`` instead.  One writer at a time; a second one finds its version
taken and fails.  All files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .state import fold, snapshot_rows

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _versions(spark: SparkSession, table: str) -> list[int]:
    fs, folder = _fs(spark, table), _path(spark, table, "manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict | None:
    """The given or latest version's manifest; None: there is no table yet."""
    versions = _versions(spark, table)
    if not versions or (version is not None and version not in versions):
        return None
    at = f"{table}/manifest/{versions[-1] if version is None else version:010d}.json"
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(at).collect())   # a line for each bucket at most
    return json.loads(text)


def _commit(spark: SparkSession, table: str, m: dict) -> None:
    fs = _fs(spark, table)
    final, draft = _path(spark, table, "manifest", f"{m['version']:010d}.json"), _path(spark, table, "manifest", f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(m, indent=0).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {m['version']} of {table} was committed by another writer")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def apply_log(spark: SparkSession, table: str, log: DataFrame, key: str, payload: list[str], patchable: list[str],
              batch_id: int | None = None, late_by: str | None = None, buckets: int = BUCKETS) -> int:
    """Fold new log rows (columns as for ``state.fold``) into the table and return
    its version.  ``late_by`` is what is subtracted from a bucket's latest time to
    give its cutoff, as SQL (``INTERVAL 1 HOUR``, ``100``); none: batches come in
    the order of their times.  ``buckets`` counts when the table is made."""
    m = manifest(spark, table) or {"version": 0, "buckets": buckets, "last_batch": None, "columns": None, "entries": {}}
    if batch_id is not None and m["last_batch"] is not None and batch_id <= m["last_batch"]:
        return m["version"]
    cols = [key, "op", "ts", "seq", "created_hint", *payload]
    ts = log.schema["ts"].dataType
    new = materialize(log.select(*cols).withColumn("bucket", _bucket(key, m["buckets"])), "log-batch")
    bound = F.max("ts") if late_by is None else F.expr(f"max(ts) - {late_by}")
    touched = {r["bucket"]: r["cut"] for r in new.groupBy("bucket").agg(bound.cast("string").alias("cut")).collect()}    # a row for each bucket at most
    if not touched:
        return m["version"]
    old = {int(b): e for b, e in m["entries"].items()}
    cuts = spark.createDataFrame([(b, old[b]["cutoff"] if b in old else None, c) for b, c in touched.items()], "bucket int, was string, cut string")
    cuts = cuts.select("bucket", F.col("was").cast(ts).alias("was"), F.greatest(F.col("was").cast(ts), F.col("cut").cast(ts)).alias("cut"))
    new = new.join(F.broadcast(cuts), "bucket")
    late = new.where(F.coalesce(F.col("ts") < F.col("was"), F.lit(False)))
    rows = new.where(F.coalesce(F.col("ts") >= F.col("was"), F.lit(True))).drop("was")
    folders = sorted({old[b]["folder"] for b in touched if b in old})
    if folders:
        stored = spark.read.option("basePath", f"{table}/data").parquet(*[f"{table}/data/{f}/state/bucket={b}" for f in folders for b in touched if b in old and old[b]["folder"] == f])
        rows = rows.unionByName(stored.select(*cols, F.col("bucket").cast("int").alias("bucket")).join(F.broadcast(cuts.drop("was")), "bucket"))
    rows = materialize(rows, "bucket-rows")
    folder = f"{m['version'] + 1:010d}-{uuid.uuid4().hex[:12]}"
    snap = snapshot_rows(fold(rows.where("ts < cut").select(*cols), key, payload, patchable), key, payload, -1)
    state = snap.select(*cols).unionByName(rows.where("ts >= cut").select(*cols)).withColumn("bucket", _bucket(key, m["buckets"]))
    state.write.partitionBy("bucket").parquet(f"{table}/data/{folder}/state")
    state = spark.read.parquet(f"{table}/data/{folder}/state")
    current = fold(state.select(*cols), key, payload, patchable)
    current.withColumn("bucket", _bucket(key, m["buckets"])).write.partitionBy("bucket").parquet(f"{table}/data/{folder}/current")
    if not late.isEmpty():
        late.drop("was", "cut").write.mode("overwrite").parquet(f"{table}/late/{folder}")
    now = {r["bucket"]: r["cut"] for r in cuts.select("bucket", F.col("cut").cast("string").alias("cut")).collect()}
    entries = m["entries"] | {str(b): {"folder": folder, "cutoff": now[b]} for b in touched}
    _commit(spark, table, {"version": m["version"] + 1, "buckets": m["buckets"], "last_batch": m["last_batch"] if batch_id is None else batch_id,
                           "columns": current.schema.jsonValue(), "entries": entries})
    return m["version"] + 1


def current_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The live rows of the latest (or a given) version: a scan of one folder for
    each bucket, no fold and no exchange.  None: there is no such version."""
    from pyspark.sql.types import StructType

    m = manifest(spark, table, version)
    if m is None:
        return None
    schema = StructType.fromJson(m["columns"])
    fs = _fs(spark, table)
    # a bucket whose keys are all deleted has no folder
    paths = [p for b, e in sorted(m["entries"].items()) if fs.exists(_path(spark, p := f"{table}/data/{e['folder']}/current/bucket={b}"))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Delete the data folders that none of the last ``keep`` versions names, and
    older manifests; returns the folders.  Only while no writer runs."""
    fs, versions = _fs(spark, table), _versions(spark, table)
    kept = versions[-keep:] if keep else []
    named = {e["folder"] for v in kept for e in manifest(spark, table, v)["entries"].values()}
    data = _path(spark, table, "data")
    gone = [s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in named] if fs.exists(data) and kept else []
    for name in gone:
        fs.delete(_path(spark, table, "data", name), True)
    for v in versions[: len(versions) - len(kept)]:
        fs.delete(_path(spark, table, "manifest", f"{v:010d}.json"), False)
    return gone
