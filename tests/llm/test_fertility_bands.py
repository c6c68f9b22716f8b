"""Operator 9: what the bands catch of symbol and table junk, and what they cost."""

import public_tokenizers

from codeloom.llm import quality_fertility
from codeloom.llm.queries import PIECE_BPE

SF = "/root/testdata/sf0.01"


def test_symbol_and_table_junk_is_rejected(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_fertility.judge(docs.select("doc_id", "text", "lang"), public_tokenizers.path(PIECE_BPE)).toPandas()
    x = got[~got["base_failed"]].merge(labels.select("doc_id", "quality").toPandas().drop_duplicates("doc_id"), on="doc_id")
    good, bad = x[x["quality"] == 1], x[x["quality"] == 0]
    assert len(bad) == 27 and (bad["n_symbols"] > 0.3 * bad["n_words"]).all()   # "a | b | c", "word&&&"
    assert (~bad["kept"]).sum() >= 22
    assert (~good["kept"]).mean() <= 0.01
