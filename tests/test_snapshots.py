"""The versioned table: equal to the fold of all log rows, batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import snapshots, state

SCHEMA = "k long, op string, ts long, seq long, created_hint long, value double, props string"
KEY, PAYLOAD, PATCHABLE = "k", ["value", "props"], ["value"]


def log_rows(n, seed, keys=40):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        op = rnd.choice(["put", "put", "patch", "delete"])
        ts = seq // 3
        out.append((0 if seq % 3 == 0 else rnd.randrange(keys), op, ts, seq, ts if op == "put" else None, float(seq) if op != "delete" else None, f"p{seq}" if op == "put" else None))
    return out


def rows(df):
    return sorted(map(tuple, df.select("k", "value", "props", "created_at", "updated_at").collect()))


def whole(spark, log):
    return rows(state.fold(spark.createDataFrame(log, SCHEMA), KEY, PAYLOAD, PATCHABLE))


def put(spark, table, log, **kw):
    return snapshots.apply_log(spark, table, spark.createDataFrame(log, SCHEMA), KEY, PAYLOAD, PATCHABLE, **kw)


def test_batches_equal_the_whole_fold(spark, tmp_path):
    table, log = str(tmp_path / "t"), log_rows(900, 1)
    for i in range(0, 900, 300):
        assert put(spark, table, log[i: i + 300], batch_id=i, buckets=8) == i // 300 + 1
        assert rows(snapshots.current_table(spark, table)) == whole(spark, log[: i + 300])
    assert put(spark, table, log[:300], batch_id=300) == 3                       # a replayed batch changes nothing
    assert rows(snapshots.current_table(spark, table, 2)) == whole(spark, log[:600])   # earlier versions stay readable
    assert put(spark, table, [], batch_id=900) == 3
    gone = snapshots.vacuum(spark, table, keep=1)
    assert len(gone) == 2 and snapshots.current_table(spark, table, 2) is None
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log)


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    table, log = str(tmp_path / "t"), log_rows(600, 2)
    put(spark, table, log, buckets=16)
    before = snapshots.manifest(spark, table)["entries"]
    put(spark, table, [(5, "put", 1000, 9000, 1000, 1.0, "new")])
    after = snapshots.manifest(spark, table)["entries"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert len(changed) == 1 and len(after) >= 10
    assert (5, 1.0, "new") in [r[:3] for r in rows(snapshots.current_table(spark, table))]
    assert rows(snapshots.current_table(spark, table)) == whole(spark, [*log, (5, "put", 1000, 9000, 1000, 1.0, "new")])


def test_a_killed_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table, log = str(tmp_path / "t"), log_rows(400, 3)
    put(spark, table, log[:200], batch_id=0, buckets=4)
    real = snapshots._commit
    monkeypatch.setattr(snapshots, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        put(spark, table, log[200:], batch_id=1)
    monkeypatch.setattr(snapshots, "_commit", real)
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log[:200])
    assert put(spark, table, log[200:], batch_id=1) == 2
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log)
    assert len(snapshots.vacuum(spark, table, keep=2)) == 1                      # what the dead writer left
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log)


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    table, log = str(tmp_path / "t"), log_rows(300, 4)
    put(spark, table, log[:100], buckets=4)
    stale = snapshots.manifest(spark, table)
    put(spark, table, log[100:200])
    monkeypatch.setattr(snapshots, "manifest", lambda *a, **k: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, table, log[200:])


def test_rows_out_of_order_within_the_bound(spark, tmp_path):
    rnd = random.Random(5)
    log = log_rows(600, 5)
    order = sorted(log, key=lambda r: r[2] + rnd.uniform(0, 40))                 # up to 40 late
    table = str(tmp_path / "t")
    for i in range(0, 600, 150):
        put(spark, table, order[i: i + 150], late_by="41", buckets=4)
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log)
    put(spark, table, [(0, "delete", 1, 10 ** 6, None, None, None)], late_by="41")     # far too late: put aside
    assert rows(snapshots.current_table(spark, table)) == whole(spark, log)
    assert spark.read.parquet(f"{table}/late/*").count() == 1


def test_all_keys_of_a_bucket_deleted_and_no_table(spark, tmp_path):
    table = str(tmp_path / "t")
    assert snapshots.current_table(spark, table) is None
    put(spark, table, [(1, "put", 1, 1, 1, 1.0, "a")], buckets=1)
    put(spark, table, [(1, "delete", 2, 2, None, None, None)])
    now = snapshots.current_table(spark, table)
    assert now.count() == 0 and now.columns == ["k", "value", "props", "created_at", "updated_at"]


def test_stream_of_files_keeps_the_table(spark, tmp_path):
    from codeloom.streaming import jobs
    src, table = str(tmp_path / "src"), str(tmp_path / "t")
    schema = "file_path string, language string, content string, op string, ts timestamp_ntz, seq long"

    def arrive(rows):
        df = spark.createDataFrame(rows, schema.replace("ts timestamp_ntz", "ts string"))
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)

    def run():
        jobs.continuous_table(spark, src, spark.read.parquet(src).schema, table, str(tmp_path / "ck"), buckets=4).awaitTermination()
        return {r.file_path: (r.language, list(r.function_names)) for r in snapshots.current_table(spark, table).collect()}
    arrive([("a.py", "python", "def f():\n    pass\n", "put", "2024-01-01 00:00:00", 1), ("b.go", "go", "package p\nfunc g() {}\n", "put", "2024-01-01 00:00:00", 2)])
    assert run() == {"a.py": ("python", ["f"]), "b.go": ("go", ["g"])}
    arrive([("a.py", "python", "def f2():\n    pass\n", "put", "2024-01-01 01:00:00", 3), ("b.go", None, None, "delete", "2024-01-01 01:00:00", 4), ("c.rs", "rust", "fn x() {}", "put", "2024-01-01 01:00:00", 5)])
    assert run() == {"a.py": ("python", ["f2"]), "c.rs": ("rust", [])}
    assert run() == {"a.py": ("python", ["f2"]), "c.rs": ("rust", [])} and snapshots.manifest(spark, table)["version"] == 2
