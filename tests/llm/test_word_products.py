"""Operator 4: a task that adds up word products holds little beside its sums."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import decontaminate as D


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


class _Caught(Exception):
    pass


class _Table:
    """Hands out the function that ``word_products`` gives its tasks."""

    def select(self, *_):
        return self

    coalesce = select

    def mapInArrow(self, run, _):
        self.run = run
        raise _Caught


@pytest.mark.parametrize("dense", [True, False])
def test_products_of_passages_need_no_second_table(monkeypatch, dense):
    rng, n = np.random.default_rng(1), 1500
    rows = [rng.integers(0, n + 200, 240).astype("<i4") for _ in range(2000)]
    rows = [np.minimum(r, n) for r in rows] + [np.full(30, 7, "<i4"), np.full(5, n, "<i4"), np.zeros(0, "<i4")]
    idf = rng.random(n) + 0.1
    if not dense:
        monkeypatch.setattr(D, "DENSE_WORDS", 0)
        monkeypatch.setattr(D, "_PAIRS", 200_000, raising=False)
    table = _Table()
    with pytest.raises(_Caught):
        D.word_products(table, idf)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["words"])
    got, count = np.zeros(n * n), 0.0

    def run():
        nonlocal count
        for b in table.run(iter([batch])):
            code, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            count += v[code < 0].sum()
            np.add.at(got, code[code >= 0], v[code >= 0])

    peak = _peak_mb(run)
    got = got.reshape(n, n)
    a = []
    for r in rows:
        for k in range(0, len(r), 24):
            x = np.bincount(r[k: k + 24], minlength=n + 1)[:n] * idf
            a.append(x / max(np.linalg.norm(x), 1e-6))
    a = np.array(a)
    want = a.T @ a
    assert count == len(a) and np.allclose(got + got.T, want)
    if dense:                                                  # the sums of all pairs, 17 MB
        assert peak < 80


def test_vocabulary_of_many_words_is_added_in_place_where_words_are_frequent():
    rng, n = np.random.default_rng(3), 5000
    rows = [np.minimum(rng.zipf(1.3, 240), n).astype("<i4") for _ in range(3000)]
    df = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=n + 1)[:n]
    idf = np.log((len(rows) + 1) / (df + 1)) + 1e-3
    table = _Table()
    with pytest.raises(_Caught):
        D.word_products(table, idf)
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["words"])
    out = []
    peak = _peak_mb(lambda: out.extend(table.run(iter([batch]))))
    code, v = (np.concatenate([b.column(k).to_numpy() for b in out]) for k in (0, 1))
    got = np.bincount(code[code >= 0], v[code >= 0], minlength=n * n)
    want = np.zeros(n * n)
    for c, x in D.passage_products(D.passages(rows, n), idf):
        np.add.at(want, c, x)
    assert np.allclose(got, want) and v[code < 0].sum() == len(rows) * 10
    assert peak < 200                                          # 259 MB when all pairs were held and sorted
