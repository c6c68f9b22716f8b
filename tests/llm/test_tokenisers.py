"""Operators 6, 9 and 10 against the tokenizers' own libraries and plain counting."""

import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
from codeloom.llm import byte_bpe, quality_fertility, ragged_bpe, token_counts  # noqa: E402

BYTE, PIECE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
    return (tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}),
            sentencepiece.SentencePieceProcessor(model_file=PIECE))


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def agree(texts, library):
    tik, sp = library
    ours = byte_bpe.tokeniser(BYTE).encode_chunk(*buffers(texts))
    model = token_counts.piece_model(PIECE)
    pre = [model.pretokens(t) for t in texts]
    model.counts.learn(set().union(*pre))
    model.tokens.learn(set().union(*pre))
    for t, x, w in zip(texts, ours, pre):
        assert np.frombuffer(x, "<u4").tolist() == tik.encode_ordinary(t)
        back, offsets = byte_bpe.tokeniser(BYTE).decode(x)
        assert back == t.encode() and len(offsets) == len(x) // 4
        ids = sp.encode(t)
        assert sum(model.counts[k] for k in w) == len(ids)
        assert np.frombuffer(b"".join(model.tokens[k] for k in w), "<u4").tolist() == ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'strevmld  \n\t019!é梦😀　 .-AZ▁\x00<s>"), max_size=80), min_size=1, max_size=8))
def test_random_texts(library, texts):
    agree(texts, library)


def test_long_and_odd_texts(library):
    rnd = random.Random(5)
    agree(["a" * 5000, " " * 700, "ab" * 3000, "", "'", "don't we'll 're' ''s", "\n\n  x\r\n", "<|endoftext|></s>", "aaa" * 100 + "b",
           "".join(rnd.choice("ABCDEFabcdef0123456789+/") for _ in range(4000))], library)


def test_merging_order_where_a_merge_makes_a_lower_rank():
    # ab merges first, then abc has a lower rank than the second ab
    order = {"ab": 5, "abc": 1, "cab": 0}
    ids = {c: i for i, c in enumerate("abc")} | {p: 10 + i for i, p in enumerate(order)}
    table = ragged_bpe.pair_table(order, ids)

    def plain(s):
        s = list(s)
        while True:
            best = min(((order[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in order), default=None)
            if best is None:
                return [ids[x] for x in s]
            i = best[1]
            s[i: i + 2] = [s[i] + s[i + 1]]

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    sym, kept = ragged_bpe.merge(np.array([ids[c] for w in words for c in w]), np.array([len(w) for w in words]), table)
    parts = np.split(sym, np.cumsum(kept)[:-1])
    assert [p.tolist() for p in parts] == [plain(w) for w in words]


def test_frames_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "don't stop", 9), (1, "don't stop", 9), (None, None, 3), (4, "", 1), (5, "x " * 20000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = byte_bpe.digests(byte_bpe.encode(df, BYTE), BYTE).collect()
    assert len(got) == 5
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df, BYTE), BYTE).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and len(r["offsets"]) == len(r["ids"]) for r in back)
    counted = token_counts.count_tokens(df, PIECE).collect()
    assert sorted(r["n_bytes"] for r in counted) == [0, 0, 10, 10, 40000] and [r["over_limit"] for r in counted].count(True) == 1
    empty = df.limit(0)
    assert byte_bpe.digests(empty, BYTE).count() == token_counts.count_tokens(empty, PIECE).count() == quality_fertility.judge(empty, PIECE, lang_col=None).count() == 0


def test_fertility_counts_and_verdicts(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeiou") + rnd.choice("bcdfgt") for _ in range(rnd.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randrange(60, 120))) for _ in range(80)]
    texts += ["ᚠᚡᚢ " * 30 + " ".join(word() for _ in range(60)),   # spelled byte by byte
              "a b c " * 40, "one two", None, "", "x\ny\nx\n\n \nx # $", "\x00w " + " ".join(word() for _ in range(60))]
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_fertility.judge(df, PIECE).collect()}
    assert len(got) == len(texts)
    import re

    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0D]+", t)
        win = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
        rep = {j for k, x in enumerate(win) if win.count(x) > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(80)) and not got[80]["kept"]
