"""Extractors read the tokens of their own language, and records are assembled once."""

from pyspark.sql import functions as F

from codeloom.operators.tokens import token_table
from codeloom.plans import q_extract as QE
from tests.conftest import files_df

FILES = [("a.go", "go", "func f(a int) int {\n\treturn a\n}\n"), ("b.py", "python", "def f(a):\n    return a\n"), ("c.java", "java", "class A { int f() { return 1; } }\n")]


def test_a_language_is_read_from_its_own_files(spark):
    s, fm = token_table(files_df(spark, FILES), 2)
    read = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    for path, language, _ in FILES:
        own = s.where(F.col("language") == language)
        assert {r.file_path for r in own.collect()} == {path}
        assert all(f"language={language}/is_token=true/" in f for f in read(own))
    assert all("/is_token=false/" in f for f in read(fm))
    assert {(r.file_path, r.language, r.content) for r in fm.collect()} == set(FILES)
    assert "is_token" not in s.columns + fm.columns


def test_records_are_written_before_they_are_ranged(spark, tmp_path, monkeypatch):
    spark.range(30).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    met = spark.sparkContext.accumulator(0)
    records = QE.code_analysis

    def counted(spark, sf_dir):
        def run(batches):
            for b in batches:
                met.add(b.num_rows)
                yield b
        a = records(spark, sf_dir)
        return a.mapInArrow(run, a.schema)

    monkeypatch.setattr(QE, "code_analysis", counted)
    stored = spark.read.parquet(QE.build_analysis_table(spark, str(tmp_path)))
    assert stored.count() == 30 and met.value == 30
