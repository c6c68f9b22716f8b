"""Operator 4: paraphrases that replace an item's rare words."""

import random

from codeloom.llm import decontaminate as D


def test_paraphrases_without_the_rare_words(spark):
    rnd, fresh = random.Random(4), iter(range(10 ** 6))
    other = lambda n: [f"x{next(fresh)}" for _ in range(n)]
    common = [f"c{i}" for i in range(80)]
    docs: list[list[str]] = [[] for _ in range(360)]
    items, leaks = [], set()
    for k in range(40):                                        # 16 words: six rare ones among the first twelve, the last three are the answer
        words = rnd.sample(common, 10)
        for i in range(6):
            words.insert(2 * i, f"r{k}q{i}")
        items.append((k, " ".join(words[:13]) + ". " + " ".join(words[13:])))
    for w, n in [*((w, 15) for w in common), *((f"r{k}q{i}", 5) for k in range(40) for i in range(6))]:
        for d in rnd.sample(range(360), n):
            docs[d] += [w, *other(9)]
    for k, text in items:
        kept = [w if w[0] == "c" else other(1)[0] for w in text.replace(".", "").split()]
        leaks.add((len(docs), k))
        docs.append([*other(rnd.randrange(40)), *kept, *other(20)])
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & leaks) >= 0.95 * len(leaks) and got <= leaks


def test_the_bound_leaves_out_no_pair():
    import numpy as np

    from codeloom.llm import decontaminate as D

    rng = np.random.default_rng(6)
    for rank in (5, 40):
        v = 300
        project = np.vstack([rng.standard_normal((v, rank)) * rng.gamma(1, 1, (v, 1)), np.zeros((1, rank))]).astype(np.float32)
        probes = [rng.integers(0, v, 16) for _ in range(21)]
        q = np.stack([project[p].sum(axis=0) for p in probes])
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        texts = [rng.integers(0, v + 1, n).astype(np.int32) for n in (0, 1, 7, 24, 25, 200, 90)] + [np.concatenate([rng.integers(0, v, 13), p, rng.integers(0, v, 30)]).astype(np.int32) for p in probes]
        flat, sizes = D._padded(texts, v)
        text, first, probe, cos = D.similar(flat, sizes, project, D.group_maxima(project, q), np.ascontiguousarray(q.T), 0.6)
        got = dict(zip(zip(text.tolist(), first.tolist(), probe.tolist()), cos.tolist()))
        want = {}
        for t, ws in enumerate(texts):
            n = max(3, -(-len(ws) // 8))
            ws = np.concatenate([ws, np.full(n * 8 - len(ws), v)])
            for b in range(n - 2):
                x = project[ws[8 * b: 8 * b + 24]].sum(axis=0)
                for p, c in enumerate(q @ x / max(np.linalg.norm(x), 1e-6)):
                    want[t, 8 * b, p] = c
        assert {k for k, c in want.items() if c >= 0.6001} <= set(got) <= {k for k, c in want.items() if c >= 0.5999}
        assert len(got) > 20 and all(abs(want[k] - c) < 1e-4 for k, c in got.items())
