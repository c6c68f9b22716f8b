"""Fold properties, vector search consistency, language resolution."""

import random

from pyspark.sql import functions as F

from codeloom.functions import languages as L
from codeloom.operators import state, vectors as V
from codeloom.sources.changelog import KEY, PATCHABLE, PAYLOAD, events_log
from tests.conftest import SF_SMALL


def _py_fold(rows):
    out = {}
    for key in {r["user_id"] for r in rows}:
        evs = sorted([r for r in rows if r["user_id"] == key], key=lambda r: (r["ts"], r["seq"]))
        cur = None
        for e in evs:
            if e["op"] == "delete":
                cur = None
            elif e["op"] == "put":
                if cur is None:
                    cur = {"created_at": e["ts"]}
                cur.update(value=e["value"], props=e["props"], kind=e["kind"], updated_at=e["ts"])
            elif e["op"] == "patch" and cur is not None:
                cur.update(value=e["value"], updated_at=e["ts"])
        if cur is not None:
            out[key] = (cur["value"], cur["props"], cur["kind"], cur["created_at"], cur["updated_at"])
    return out


def test_fold_matches_sequential_replay_and_ignores_row_order(spark):
    log = events_log(spark, SF_SMALL)
    rows = [r.asDict() for r in log.collect()]
    exp = _py_fold(rows)
    random.Random(1).shuffle(rows)
    shuffled = spark.createDataFrame(rows, log.schema).repartition(7)
    got = {r.user_id: (r.value, r.props, r.kind, r.created_at, r.updated_at)
           for r in state.fold(shuffled, KEY, PAYLOAD, PATCHABLE).collect()}
    assert got == exp


def test_patch_only_key_has_no_row(spark):
    df = spark.createDataFrame([(1, "patch", 1, 1, 1, 5.0, None, None)],
                               "user_id long, op string, ts long, seq long, created_hint long, value double, "
                               "props string, kind string")
    assert state.fold(df, KEY, PAYLOAD, PATCHABLE).count() == 0


def test_batch_topk_equals_single_topk(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    qs = emb.orderBy("id").limit(3).select(F.col("id").alias("qid"), "embedding")
    batch = V.topk_batch(spark, qs, emb, 5, dim=64).collect()
    for q in qs.collect():
        single = [r.id for r in V.topk_single(emb, q.embedding, 5).orderBy("rank").collect()]
        assert [r.id for r in sorted([b for b in batch if b.qid == q.qid], key=lambda b: b.rank)] == single


def test_missing_index_is_empty(spark, tmp_path):
    from codeloom import schemas
    assert V.load_index(spark, str(tmp_path / "nope"), schemas.VECTORS).count() == 0


def test_fourth_language_by_rows_only(spark):
    dim = L.language_dim(spark, extra_rows=[("rs", "rust", "*.rs", "//", "RustParser")])
    df = spark.createDataFrame([("/a/b.RS",), ("/a/.bashrc",), ("/a/x.py",)], "p string")
    got = {r.p: r.language for r in L.resolve_by_extension(df, "p", dim).collect()}
    assert got == {"/a/b.RS": "rust", "/a/.bashrc": None, "/a/x.py": "python"}


def test_language_listing_membership_and_info(spark):
    dim = L.language_dim(spark)
    assert sorted(r.alias for r in L.supported_languages(dim).collect()) == ["go", "golang", "java", "py", "python"]
    df = spark.createDataFrame([("PY",), ("rust",), ("GoLang",)], "x string")
    assert sorted(r.x for r in L.is_supported(df, F.col("x"), dim).collect()) == ["GoLang", "PY"]
    info = L.parser_info(dim).first().parsers
    assert info["py"] == "PythonParser" and info["golang"] == "GoParser" and len(info) == 5


def test_language_distribution_map(spark):
    from codeloom.operators import stats
    df = spark.createDataFrame([("a", "go"), ("b", "go"), ("c", "java")], "file_path string, language string")
    m = stats.distribution_map(stats.language_distribution(df)).first().language_distribution
    assert m == {"go": 2, "java": 1}


def test_fold_with_a_hot_key_holding_a_third_of_the_log(spark):
    rnd = random.Random(9)
    rows = []
    for seq in range(3000):
        key = 0 if seq % 3 == 0 else rnd.randint(1, 200)
        op = rnd.choice(["put", "put", "patch", "delete"])
        rows.append({"user_id": key, "op": op, "ts": rnd.randint(0, 10_000), "seq": seq, "created_hint": None,
                     "value": float(seq), "props": f"p{seq}" if op == "put" else None,
                     "kind": "k" if op == "put" else None})
    for r in rows:
        r["created_hint"] = r["ts"] if r["op"] == "put" else None
    df = spark.createDataFrame(rows, "user_id long, op string, ts long, seq long, created_hint long, value double, "
                                     "props string, kind string").repartition(5)
    got = {r.user_id: (r.value, r.props, r.kind, r.created_at, r.updated_at)
           for r in state.fold(df, KEY, PAYLOAD, PATCHABLE).collect()}
    assert got == _py_fold(rows)


def test_batch_topk_takes_the_least_ids_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(40)] + [(100 + i, [0.1 * i, 0.0, 0.0]) for i in range(30)]
    emb = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(7)
    qs = spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("b", [0.5, 0.0, 0.0])], "qid string, embedding array<float>")
    for block in (2048, 9):
        got = V.topk_batch(spark, qs, emb, 5, block=block).orderBy("qid", "rank").collect()
        assert [r.id for r in got if r.qid == "a"] == [0, 1, 2, 3, 4]
        single = {q.qid: [r.id for r in V.topk_single(emb, q.embedding, 5).orderBy("rank").collect()] for q in qs.collect()}
        assert {k: [r.id for r in got if r.qid == k] for k in ("a", "b")} == single
