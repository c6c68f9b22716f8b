"""Extra columns named like anything that an operator or stage uses under way."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import byte_bpe, decontaminate, language_id, minhash, quality_fertility, secret_scan, simhash, suffix_dedup, token_counts, toxicity, url_filter
from codeloom.llm.queries import BYTE_BPE, PIECE_BPE, tokenizer_path

NAMES = ["__text", "__s", "__key", "key", "__lang", "__declared", "__host", "__id", "__ids", "__says", "__allow", "fp", "id", "row", "c0", "c1", "k0", "host_mass", "node", "root", "own", "lang", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    extra = {n: f"extra {n}" for n in NAMES if n != "lang"}
    return base.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(v).alias(k) for k, v in extra.items()])


def holds(out, odd, gone=(), rows=40):
    got = out.collect()
    assert len(got) == rows
    for n in NAMES:
        if n not in gone and n != "lang":
            assert {r[n] for r in got} <= {f"extra {n}"}, n
    return got


def test_operators_keep_columns_of_any_name(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    holds(simhash.near_duplicates(odd), odd, {"fp"})
    holds(minhash.near_duplicates(odd), odd)
    assert simhash.deduplicate(odd).columns == odd.columns
    pages = odd.withColumnRenamed("text", "url")
    holds(url_filter.judge(pages), odd)
    holds(toxicity.score(odd, odd.join(labels, "doc_id").selectExpr("doc_id as id", "text", "toxic as y")), odd)
    assert decontaminate.find_leaks(odd, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).columns[:2] == ["doc_id", "item_id"]
    holds(suffix_dedup.remove_repeats(odd), odd)
    holds(token_counts.count_tokens(odd, tokenizer_path(PIECE_BPE)), odd)
    holds(secret_scan.scan(odd)[0], odd)
    holds(language_id.identify(odd, declared_col="lang", host_col="source"), odd)
    holds(quality_fertility.judge(odd, tokenizer_path(PIECE_BPE)), odd)
    holds(byte_bpe.digests(odd, tokenizer_path(BYTE_BPE)), odd)
    encoded = byte_bpe.encode(odd.select("doc_id", "text", "__ids", "__text"), tokenizer_path(BYTE_BPE))
    assert {r["__ids"] for r in byte_bpe.decode(encoded, tokenizer_path(BYTE_BPE)).collect()} == {"extra __ids"}


def test_stages_keep_columns_of_any_name(spark, odd):
    docs, rows = odd, 40
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns[: len(odd.columns)] == odd.columns, name
        rows = len(holds(docs, odd, rows=docs.count()))
    assert rows > 0
