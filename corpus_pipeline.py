"""The training-data pipeline over ``documents``.

Each stage works on all that the one before it kept, is written as Parquet under
the cluster's shared folder and reread, so a lost executor costs one stage's
tasks at most.  The first four keep the columns of ``documents``, whatever other
columns there are and however they are named.  Null and empty texts are rejected
by language identification; an empty table gives an empty table in every stage;
of repeated rows, near-duplicate removal leaves one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, decontaminate, language_id, secret_scan, simhash
from codeloom.llm.common import join_counted, materialize, scratch_path, table, unique_name
from codeloom.llm.queries import BYTE_BPE, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification; documents that it rejects go."""
    out = language_id.identify(docs, declared_col="lang", host_col="source")
    return out.filter("accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates by three-word shingles and three bits, as in the
    operator's contract; one document of each group stays."""
    return simhash.deduplicate(docs, shingle=3, max_bits=3).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination; documents that leak an item go (a document
    without an id is judged by its text, so it is searched under its digest)."""
    own, = unique_name(docs, "key")
    keyed = docs.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    leaks = decontaminate.find_leaks(keyed.select(own, "text"), table(spark, sf_dir, "benchmark"), id_col=own)
    bad = materialize(leaks.select(own).distinct(), "leaking-texts")
    return join_counted(keyed, bad, [own], "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan; every span found is masked by asterisks."""
    found, _ = secret_scan.scan(docs)
    spans = found.select(*docs.columns, "spans")
    return spans.withColumn("text", secret_scan.mask(F.col("text"), F.col("spans"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level token ids, with digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs, tokenizer_path(BYTE_BPE), ids_col="ids")


STAGES = [("language_id", language), ("simhash_dedup", near_duplicates), ("decontamination", contamination), ("secret_scan", secrets), ("byte_bpe", tokens)]
#: Language identification, latent retrieval and pair merging are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
