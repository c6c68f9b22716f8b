"""Joins of what grows with the files send neither side to the driver, however
little room a table takes on disk."""

from codeloom.operators import extract_python as XP
from codeloom.operators.tokens import token_table
from codeloom.plans import q_extract, q_search
from codeloom.session import materialize
from tests.conftest import files_df
from tests.test_properties import _files


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_and_languages(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    v = q_search.code_vectors(spark, str(tmp_path))
    assert "Broadcast" not in _plan(v) and "SortMergeJoin" in _plan(v)
    assert sorted(r.file_path for r in v.collect()) == sorted(r.file_path for r in q_search.code_texts(spark, str(tmp_path)).collect())


def test_tokens_and_definitions(spark):
    s, fm = token_table(files_df(spark, _files(seed=5, per_lang=4)), 2)
    d = XP.definitions(XP.prepare(s), fm)
    assert "Broadcast" not in _plan(d)
    f, c = XP.split_definitions(materialize(d, "defs", "file_path", 2))
    assert f.count() and "Broadcast" not in _plan(XP.class_methods(f, c))


def test_definitions_are_made_once(spark, tmp_path):
    spark.range(9).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    plan = _plan(q_extract.py_classes(spark, str(tmp_path)))
    assert "py_defs" in plan and "codeloom_tokens" not in plan


def test_records_meet_their_files_without_a_broadcast(spark, tmp_path):
    spark.range(9).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    plan = _plan(q_extract.code_analysis(spark, str(tmp_path)))
    assert "Broadcast" not in plan and "min(cast(file_balanced" not in plan      # the flag comes with the file, not from its tokens


def test_a_files_row_tells_whether_it_is_balanced(spark):
    rows = [("a.java", "java", "class A { int f() { return 1; } }"), ("b.java", "java", "class B { int f( { return 1; } }"), ("c.java", "java", "// nothing"), ("d.go", "go", "func f() {}")]
    _, fm = token_table(files_df(spark, rows), 2)
    assert {r.file_path: r.file_balanced for r in fm.collect()} == {"a.java": True, "b.java": False, "c.java": None, "d.go": None}
