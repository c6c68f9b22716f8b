"""Operators 11, 12 and 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from codeloom.llm import minhash, prefix_trie, spelling


# ---- 11: MinHash ---------------------------------------------------------------

def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows):
    """{row number: smallest reachable id} by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))], [len(s) for s in sets]


def edited(rnd, words, k):
    out = list(words)
    for _ in range(k):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10 ** 6)}"
    return out


def minhash_rows(seed):
    """Copies, chains of edits that drift below the similarity, groups around one
    text, a passage that all share, short texts and blanks."""
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    passage = text(40)
    out = [" ".join(text(rnd.randrange(60, 200)) + passage) for _ in range(60)]
    for _ in range(6):
        base = text(200)
        out += [" ".join(edited(rnd, base, rnd.randrange(5))) for _ in range(15)]
        for _ in range(8):
            base = edited(rnd, base, 2)
            out.append(" ".join(base))
    out += ["One two", "ONE  TWO", "one two three four five", "one two three four five six", "É a b c d", "é a b c d", "", " \n\t", None, out[0], out[0].upper(), "x" * 50_000]
    ids = rnd.sample(range(10_000), len(out))
    return list(zip(ids, out))


def test_minhash_against_all_pairs(spark):
    for seed, block in ((1, minhash.BLOCK), (2, 4)):           # 4: keys cut into many blocks
        rows = minhash_rows(seed)
        want, sizes = linked(rows)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string"), block=block).collect()}
        assert {d: (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) for d, _ in rows} == {d: (n, c, c == d) for (d, _), n, c in zip(rows, sizes, want)}
        assert got[rows[0][0]]["source"] == "x"


def test_minhash_links_that_no_pivot_sees(spark):
    """A chain in which only neighbours are near: each link must be found."""
    rnd = random.Random(5)
    base, rows = [f"c{i}" for i in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(base)))
        at = 7 * i
        base = base[:at] + [f"n{i}"] + base[at + 1:]
    rnd.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    want, _ = linked(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for (d, _), c in zip(rows, want)}


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2 ** 16, (200, minhash.SYMBOLS)).astype("<u2")
    b = a.copy()
    for x in b:                                                # the worst case: two errors in all chunks but one
        at = np.concatenate([c * minhash.WIDTH + rng.permutation(minhash.WIDTH)[:2] for c in range(minhash.CHUNKS)])
        x[at[:-1]] ^= 1
    assert ((a != b).sum(axis=1) == minhash.DISTANCE).all()
    assert all(set(x) & set(y) for x, y in zip(minhash.chunk_keys(a).tolist(), minhash.chunk_keys(b).tolist()))


def test_minhash_nulls_repeats_clashes_empty(spark):
    t = "a b c d e f g h"
    rows = [(None, t), (None, "p q r s t u"), (7, t), (7, t), (9, t), (3, None), (None, ""), (7, "other words that are not like the rest at all")]
    df = spark.createDataFrame([(d, x, 5, "k", 1) for d, x in rows], "doc_id long, text string, kept int, key string, n long")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"], r["key"], r["n"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 4, 7, False, "k", 1), (None, 2, None, False, "k", 1), (7, 4, 7, True, "k", 1), (7, 4, 7, True, "k", 1), (9, 4, 7, False, "k", 1), (3, 0, 3, True, "k", 1),
                          (None, 0, None, False, "k", 1), (7, 6, 7, True, "k", 1)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


# ---- 12: spelling ----------------------------------------------------------------

def one_edit(u, v):
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_variants(rows, min_count=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def spelling_rows(seed):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abÀé") for _ in range(rnd.randrange(5, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Ababab", "ÉCOLES", "écoles", "z" * 3000, "z" * 3001]
    words = []
    for s in stems:
        words += [s] * rnd.choice([1, 5, 30, 200])
        for _ in range(4):
            i = rnd.randrange(len(s))
            words += [rnd.choice([s[:i] + s[i + 1:], s[:i] + rnd.choice("abé") + s[i:], s[:i] + "b" + s[i + 1:]])] * rnd.choice([1, 5, 6, 40])
    rnd.shuffle(words)
    return [(i if i % 50 else None, " ".join(words[k: k + 7]) + rnd.choice(["", " 12-x", "\n..."])) for i, k in enumerate(range(0, len(words), 7))] + [(1, None), (2, ""), (2, "")]


def test_spelling_against_all_pairs(spark):
    rows = spelling_rows(4)
    df = spark.createDataFrame([(d, t, "w") for d, t in rows], "doc_id long, text string, word string")
    got = spelling.variants(df).collect()
    assert {tuple(r) for r in got} == plain_variants(rows) and len(got) == len({r["word"] for r in got}) > 60
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.filter("text is null")).count() == 0


def test_near_words_in_groups_split_to_the_last(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 9))) for _ in range(400)})
    want = {(u, v) for u in words for v in words if u != v and one_edit(u, v)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for group in (1, 3, spelling.GROUP):
        got = [tuple(r) for r in spelling.near_words(df, group=group).collect()]
        assert len(got) == len(want) and set(got) == want


def test_acceptor_is_minimal():
    words = sorted(["tap", "taps", "top", "tops", "stop", "stops"])
    states, known = [], {}
    root = spelling.acceptor(words, states, known)
    assert len(states) == 7
    reached = [("", root)]
    for w, s in reached:
        reached += [(w + c, x) for c, x in states[s][1].items()]
    assert sorted(w for w, s in reached if states[s][0]) == words


# ---- 13: prefix trie -------------------------------------------------------------

def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        seqs[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = set()
    for s, cs in members.items():
        under = [x for x in members if x[: len(s)] == s]
        kids = [x for x in under if len(x) == len(s) + 1]
        ends = ",".join(map(str, sorted(c for c in cs if seqs[c] == s)))
        out.add((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), len(kids), sum(not any(y[: len(x)] == x and len(y) > len(x) for y in under) for x in under),
                 sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows(seed):
    rnd = random.Random(seed)
    say = lambda: rnd.choice(["hi", "hello there", "", None, "é!", "no", "yes"])
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(-105, -95), 350, 351, 10 ** 12 + 3]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), say()))
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(6)]            # copies
    rows += [rows[3], rows[3], (None, 0, "user", "x"), (7, 3, "user", "tie b"), (7, 3, "user", "tie a")]
    rnd.shuffle(rows)
    return rows


def test_trie_against_all_prefixes(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string, depth int"
    for seed, chunk in ((1, prefix_trie.CHUNK), (2, 3)):        # 3: running values carried from chunk to chunk
        monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
        rows = conversation_rows(seed)
        got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, 5) for r in rows], schema).repartition(4)).collect()
        want = plain_trie(rows)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0


def test_a_conversation_over_several_tasks(spark):
    rows = [(5, t, "user", f"t{t % 50}") for t in range(20_000)] + [(6, t, "user", f"t{t}") for t in range(3)]
    got = {r["depth"]: r for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)).collect()
           if r["conv_id"] == 5}
    h = zlib.crc32(b"5") % 6
    assert max(got) == 20_000 - h and got[20_000 - h]["n_children"] == 0 and got[1]["n_leaves"] >= 1
    assert got[20_000 - h]["ends_sha256"] == hashlib.sha256(b"5").hexdigest()


def test_member_lists_longer_than_a_piece(spark):
    ids = list(range(1, prefix_trie.PIECE * 2 + 77))
    got = prefix_trie.conversation_trie(spark.createDataFrame([(100 * i, 0, "user", "x") for i in ids], "conv_id long, turn long, role string, text string")).collect()
    leaf = next(r for r in got if r["depth"] == 1)
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(str(100 * i) for i in ids).encode()).hexdigest() and leaf["n_convs"] == len(ids)
    assert leaf["saved_tokens"] == len(ids) - 1 and len(got) == 2
