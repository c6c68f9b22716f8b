"""S1 scan edges, S12, U2, U3, P11."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions.models import model_embedder
from codeloom.functions.sql import register_sql_functions
from codeloom.operators import search as S
from codeloom.operators import vectors as V
from codeloom.sources.repo_scan import scan_repo


def _tree(root):
    files = {
        "pkg/__init__.py": b"import os\n",
        "pkg/_und/y.py": b"def y():\n    return 1\n",
        ".hidden/x.py": b"def hidden():\n    pass\n",
        "pkg/.dot.py": b"x = 1\n",
        "pkg/bad.py": b"x = '\xff'\n",
        "pkg/Lat.java": "class Lat { String s = \"café\"; }\n".encode("latin-1"),
        "main.go": b"package main\n",
        "notes.txt": b"hello\n",
    }
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    os.makedirs(os.path.join(root, "pkg", "dir.py"), exist_ok=True)


def test_scan_repo_edges(spark, tmp_path):
    root = str(tmp_path / "repo")
    _tree(root)
    files, rejects = scan_repo(spark, root)
    got = {r.file_path[len(root):]: (r.language, r.content) for r in files.collect()}
    assert set(got) == {"/pkg/__init__.py", "/pkg/_und/y.py", "/pkg/Lat.java", "/main.go"}
    assert got["/pkg/Lat.java"][1] == "class Lat { String s = \"café\"; }\n"
    assert [r.file_path[len(root):] for r in rejects.collect()] == ["/pkg/bad.py"]


def test_scan_missing_root_is_empty(spark, tmp_path):
    files, rejects = scan_repo(spark, str(tmp_path / "nope"))
    assert files.count() == 0 and rejects.count() == 0


def test_empty_index_create_and_clear(spark, tmp_path):
    path = str(tmp_path / "idx")
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "embedding", "label")
    V.save_index(V.build_index(emb, 64), path)
    assert V.load_index(spark, path, schemas.VECTORS).count() == 500
    V.empty_index(spark, schemas.VECTORS, path)
    assert V.load_index(spark, path, schemas.VECTORS).count() == 0


def test_dimension_is_enforced(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2], 0)], "id long, embedding array<float>, label int")
    with pytest.raises(Exception):
        V.build_index(df, 64).collect()


def test_sql_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("SELECT lang_of('/a/B.PY') AS a, lang_of('/a/.bashrc') AS b, "
                  "inner_product(array(CAST(1 AS FLOAT), CAST(2 AS FLOAT)), "
                  "array(CAST(3 AS FLOAT), CAST(4 AS FLOAT))) AS c").first()
    assert (r.a, r.b, r.c) == ("python", None, 11.0)


def test_pluggable_model(spark):
    def make_fn():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)
        return predict
    embed = model_embedder(make_fn, dim=2)
    r = spark.createDataFrame([("abc",), ("hello",)], "t string").select(embed(F.col("t")).alias("e")).collect()
    assert sorted(tuple(x.e) for x in r) == [(3.0, 1.0), (5.0, 1.0)]


def test_search_dispatch(spark):
    a = spark.createDataFrame([], schemas.ANALYSIS)
    with pytest.raises(ValueError):
        S.search_code(a, None, "x", search_type="bogus")
    assert S.search_code(a, None, "run", search_type="function_name").count() == 0


def test_semantic_search_dispatch_with_default_model(spark):
    docs = spark.createDataFrame([("a.py", "def run parse tokens"), ("b.go", "func main print"),
                                  ("c.java", "class Parser parse tokens tree")], "file_path string, t string")
    vecs = V.hash_embed(docs, "file_path", "t", 64).withColumn("language", F.lit("x"))
    a = spark.createDataFrame([], schemas.ANALYSIS)
    res = S.search_code(a, vecs, "parse tokens", search_type="semantic", top_k=2,
                        embed=lambda q: V.embed_text(spark, q, 64))
    got = [r.file_path for r in res.orderBy("rank").collect()]
    assert got[0] in ("a.py", "c.java") and len(got) == 2 and "b.go" not in got
