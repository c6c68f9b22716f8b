"""Plan assertions: the physical plans we rely on at scale."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from codeloom.operators import search as S
from codeloom.operators import state
from codeloom.operators import vectors as V
from codeloom.sources.changelog import KEY, PATCHABLE, PAYLOAD, events_log
from tests.conftest import SF_SMALL


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _emb(spark):
    return spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def test_single_topk_is_take_ordered(spark):
    emb = _emb(spark)
    q = emb.orderBy("id").first().embedding
    p = _plan(V.topk_single(emb, q, 5))
    assert "TakeOrderedAndProject" in p


def test_batch_topk_has_window_group_limit(spark):
    emb = _emb(spark)
    qs = emb.orderBy("id").limit(4).select(F.col("id").alias("qid"), "embedding")
    p = _plan(V.topk_batch(spark, qs, emb, 5, dim=64))
    assert "WindowGroupLimit" in p


def test_search_pushes_nested_predicates(spark, tmp_path):
    from codeloom import schemas
    path = str(tmp_path / "a")
    spark.createDataFrame([], schemas.ANALYSIS).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")) \
        .write.parquet(path)
    r = S.search_results(spark.read.parquet(path), language="go", min_complexity=2.0, max_complexity=3.0, limit=5)
    p = _plan(r.select("file_path"))
    assert "GreaterThanOrEqual(metrics.average_complexity,2.0)" in p
    assert "EqualTo(language,go)" in p
    assert "TakeOrderedAndProject" in p


def test_fold_aggregates_partially_before_shuffle(spark):
    f = state.fold(events_log(spark, SF_SMALL), KEY, PAYLOAD, PATCHABLE)
    p = _plan(f, "simple")
    assert "partial_max_by" in p and "partial_min" in p
    assert "Window" not in p


def _exchanges(plan):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_fold_meets_tombstones_by_key_and_salt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(state.fold(events_log(spark, SF_SMALL), KEY, PAYLOAD, PATCHABLE), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    join = next(line for line in p.splitlines() if "SortMergeJoin" in line)
    assert "__salt" in join
    assert sum("__salt" in line for line in _exchanges(p)) == 2        # the log and the tombstones, nothing again


def test_one_tokenisation_and_one_shuffle_of_contents(spark):
    from codeloom.operators.analysis import analyse
    from tests.conftest import files_df
    p = _plan(analyse(files_df(spark, [("a.py", "python", "x = 1")])), "simple")
    assert "regexp_extract_all(content" not in p
    assert not any("content" in line for line in _exchanges(p))


def test_summary_and_listing_read_no_bodies(spark):
    from codeloom.operators import analysis as AN
    from codeloom.plans.q_extract import analysis_table
    t = analysis_table(spark, SF_SMALL)
    for df in (AN.summary(t), S.get_result(t, "/repo/b1/f_1.go").select("file_path", "n_functions", "metrics.total_lines")):
        assert "body_text" not in _plan(df)


def test_embedding_moves_nothing(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert "Exchange" not in _plan(V.hash_embed_sparse(docs, "doc_id", "text"), "simple")


def test_rolling_counts_before_windows(spark):
    from codeloom.streaming.jobs import rolling_activity
    p = _plan(rolling_activity(spark.read.parquet(f"{SF_SMALL}/events.parquet")), "simple")
    assert p.count("partial_count") == 1 and p.count("Expand") <= 1
