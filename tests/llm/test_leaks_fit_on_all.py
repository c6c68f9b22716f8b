"""Operator 4: the latent space is fitted on every passage of every document."""

import numpy as np
import pytest

from codeloom.llm import decontaminate as D


@pytest.mark.parametrize("dense", [True, False])
def test_products_of_all_passages(spark, monkeypatch, dense):
    rng, n = np.random.default_rng(3), 30
    rows = [rng.integers(0, n + 1, size).astype("<i4") for size in (0, 1, 23, 24, 25, 200, *[40] * 2000)]
    idf = rng.random(n) + 0.1
    if not dense:
        monkeypatch.setattr(D, "DENSE_WORDS", 0)
    numbers = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(rows)], "__id int, words binary").repartition(5)
    products, count = D.word_products(numbers, idf)
    a = []
    for r in rows:
        for k in range(0, len(r), 24):
            x = np.bincount(r[k: k + 24], minlength=n + 1)[:n] * idf
            a.append(x / max(np.linalg.norm(x), 1e-6))
    want, got = np.array(a).T @ np.array(a), np.zeros((n, n))
    for r in products.collect():
        got[r["row"], r["col"]] += r["v"]
    assert count == len(a) and np.allclose(got, want)
