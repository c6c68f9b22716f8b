"""Operators 1 and 5 against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from codeloom.llm import simhash, suffix_dedup
from codeloom.llm.components import components


def fingerprint(text):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall("[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i: i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def by_brute_force(codes, limit):
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    codes = sorted(set(codes))
    for i, a in enumerate(codes):
        for b in codes[i + 1:]:
            if (a ^ b).bit_count() <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def test_links_keep_all_components_over_a_deep_tree(spark):
    rnd = random.Random(4)
    codes = [rnd.getrandbits(64) for _ in range(1500)]
    for c in codes[:150]:                                      # chains and dense groups
        for _ in range(rnd.randrange(1, 6)):
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                c ^= 1 << b
            codes.append(c)
    codes += [codes[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    signed = [c - (1 << 64) if c >> 63 else c for c in set(codes)]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = components(simhash.links(df, 3, block=16)).collect()
    roots = {r["node"]: r["root"] for r in found}
    groups = {}
    for c in set(codes):
        s = c - (1 << 64) if c >> 63 else c
        groups.setdefault(roots.get(s, s), set()).add(c)
    truth = {}
    for c, r in by_brute_force(codes, 3).items():
        truth.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_near_duplicates_of_texts(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 200))) for _ in range(120)]
    texts += [t.upper() for t in texts[:20]] + [t + " tail" for t in texts[20:60]] + ["", " \n", "one", "ONE", "É é", None, texts[0]]
    df = spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    fps = {1000 - i: fingerprint(t) for i, t in enumerate(texts)}
    root = by_brute_force(fps.values(), 3)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(least.get(root[f], d), d)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", least[root[f]]) for d, f in fps.items()}
    kept = simhash.deduplicate(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values()) and kept[0].asDict().keys() == {"doc_id", "text", "fp"}


def test_near_duplicates_null_ids_repeats_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "x y z w"), (7, "x y z w"), (9, "x y z w")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 5 and {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (7, 7), (9, 7)}
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(df).collect()) == ["7", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.deduplicate(df.limit(0)).count() == 0


def repeats(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for x in raw:
        for i in range(len(x) - length + 1):
            seen[x[i: i + length]] = seen.get(x[i: i + length], 0) + 1
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i: i + length]] > 1:
                gone[i: i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        yield len(x), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()


def test_suffix_dedup_is_exact(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab c") for _ in range(300)) for _ in range(6)]
    piece = lambda: rnd.choice([rnd.choice(base)[: rnd.randrange(10, 300)], "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(30)))])
    texts = ["".join(piece() for _ in range(rnd.randrange(8))) for _ in range(250)]
    texts += ["a" * 700, "ab" * 300, "", None, "é" * 100, "x" * 39, "a" * 41, *texts[:20], "ab" * 300]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, tk string").repartition(5)
    for sizes in ({"bucket_bytes": 2_000}, {}):      # hot grams split over buckets, and not
        got = suffix_dedup.remove_repeats(df, length=40, gram=12, **sizes).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(repeats(texts, 40)))
        assert {r["tk"] for r in got} == {"k"} and all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert suffix_dedup.remove_repeats(df.limit(0), length=40, gram=12).count() == 0


def test_a_text_longer_than_a_segment(spark):
    rnd = np.random.default_rng(1)
    long = rnd.integers(97, 123, (1 << 20) + 5000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(0, long), (1, "head " + long[(1 << 20) - 450: (1 << 20) + 300] + " tail"), (2, long[:399])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], [(s["start"], s["stop"]) for s in r["spans"]]) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {0: (750, [((1 << 20) - 450, (1 << 20) + 300)]), 1: (750, [(5, 755)]), 2: (0, [])}


def test_sorted_heads_are_in_suffix_order():
    rnd = random.Random(8)
    data = "".join(rnd.choice(["abab" * 20, "xy", "abc", "q" * 70]) for _ in range(200)).encode()
    starts = np.arange(len(data) - 100)
    order, same = suffix_dedup.sorted_heads(data, starts, 100)
    heads = [data[s: s + 100] for s in order.tolist()]
    assert heads == sorted(heads)
    assert same[1:].tolist() == [a == b for a, b in zip(heads, heads[1:])]
