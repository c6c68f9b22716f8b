"""Operator 4 and its pipeline stage: benchmark items of under eight words."""

import corpus_pipeline
from codeloom.llm import queries


def test_short_items_are_matched_as_contiguous_words(spark, tmp_path):
    sf = str(tmp_path)
    docs = [(1, "He asked: What is THE capital, of Peru? Lima."), (2, "what is the old capital of peru lima"), (3, None), (3, ""), (4, "the capital of peru lima what is"),
            (5, "what is the what is the capital of peru lima what is the capital of peru lima"), (5, "lima"), (None, "Lima")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(7, "What is the capital of Peru? Lima"), (8, None), (9, "."), (10, "lima, what")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(repr, ((r["doc_id"], r["item_id"], r["word_from"], r["word_to"], r["lcs_share"]) for r in queries.op4_decontamination(spark, sf).collect())))
    assert got == ["(1, 7, 2, 9, 1.0)", "(4, 10, 4, 6, 1.0)", "(5, 10, 9, 11, 1.0)", "(5, 7, 3, 10, 1.0)"]
    left = corpus_pipeline.contamination(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(str(r["text"]) for r in left.collect()) == sorted(["", "None", "lima", "Lima", docs[1][1]])
