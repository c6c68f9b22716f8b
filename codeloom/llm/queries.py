"""The registered queries of the ten operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import byte_bpe, decontaminate, language_id, minhash, prefix_trie, quality_fertility, secret_scan, simhash, spelling, suffix_dedup, token_counts, toxicity, url_filter
from codeloom.llm.common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path(PIECE_BPE)).drop("text")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(found)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs, declared_col="lang", host_col="source").drop("text")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over ``pages``, with their markup's language, address
    suffix and host as evidence."""
    pages = language_id.page_columns(table(spark, sf_dir, "pages")).select("page_id", "page_text", "page_lang", "page_host", "page_suffix")
    return language_id.identify(pages, "page_text", "page_lang", "page_host", "page_suffix").drop("page_text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_fertility.judge(docs, tokenizer_path(PIECE_BPE)).drop("lang")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, tokenizer_path(BYTE_BPE)).drop("text")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_toxicity, op4_decontamination, op5_suffix_dedup, op6_token_counts, op7_secret_scan, op8_language_id, op9_quality_rules, op10_byte_bpe,
                                     op11_minhash, op12_spelling, op13_conversation_trie, page_language_id)}


def oracles() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle_sql(), "op7_secret_scan": secret_scan.oracle_sql(),
            "op11_minhash": minhash.oracle_sql(), "op12_spelling": spelling.oracle_sql(), "op13_conversation_trie": prefix_trie.oracle_sql()}
