"""Operator 1: a task that compares fingerprints holds little beside them."""

import tracemalloc

import numpy as np

from codeloom.llm import simhash as S


def _peak_mb(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_dense_group_of_fingerprints_is_compared_in_little_memory():
    x = np.arange(8192, dtype=np.uint64)
    few = x[np.bitwise_count(x) <= 2]                          # within four bits of each other
    codes = np.sort(np.concatenate([few ^ np.uint64(k << 13) for k in range(89)]))
    child = []
    assert _peak_mb(lambda: child.append(S.near(codes, codes, 3, True, 16))) < 40
    u, v = child[0]
    assert len(u) == len(codes) - 1                            # one component
    assert len(np.unique(u)) == len(u) and not np.isin(codes[0], u)
