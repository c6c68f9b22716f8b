"""Registered plans against their DuckDB oracles on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, digest

FAST = ["line_metrics", "language_distribution", "upsert_fold", "patch_fold", "delete_fold", "changelog_fold",
        "compact", "dedup_latest", "sink_roundtrip", "alerts_normalise", "alert_history", "database_stats",
        "recent_24h", "semantic_topk", "semantic_topk_batch", "cosine_topk", "vector_stats", "hash_embed",
        "lang_by_alias", "lang_by_extension", "path_remap", "decode_policy", "json_roundtrip", "rolling_24h",
        "py_functions", "go_structs", "java_class_methods", "java_methods_regex", "java_fallback",
        "analysis_record", "search_results_all", "function_name_search", "complexity_range",
        "alert_related", "alert_result", "analysis_response", "search_dispatch", "scan_rejects", "analysis_errors",
        "vector_upsert", "text_repr", "text_repr_200", "alerts_ingest_once", "continuous_analysis", "sql_functions"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def test_every_query_has_callable_and_entry_runs(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() >= 0


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    srows, drows = [tuple(r) for r in sdf.collect()], rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert digest(sdf.columns, srows)[0] == digest(rel.columns, drows)[0]
