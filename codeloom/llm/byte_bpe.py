"""Operator 10: byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no regular expression.  Each code point
of a chunk of texts becomes a class number (letter, number, other, the four
kinds of white space and apostrophe that the pattern tells apart, found with
two neighbours' classes).  A class is a function from automaton state to state;
such functions compose associatively, so each lane of 64 code points composes
its own, a logarithmic scan over lanes gives every lane its entry state, and one
more sweep gives every position its state, hence the token starts.  The slices
feed a cached, array-wise pair merge (``ragged_bpe``); decoding gathers the
tokens' bytes by the offsets kept from their lengths.

Defined results: null text counts as empty (0 tokens, hashes of no bytes); rows
are kept as they are (repeated rows, null ids, extra columns); output columns
replace columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeloom.llm import ragged_bpe
from codeloom.llm.common import bounded_batches, row_groups, unique_name, utf8_buffer

# Raw code-point classes.
LETTER, ONE, RV, EL, EE, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER = range(10)
# Classes the automaton reads: a contraction needs one or two letters more; a
# space may join what follows; other white space alone, or inside a run.
C_LETTER, C_NUMBER, C_OTHER, C_SHORT, C_LONG, C_JOIN, C_ALONE, C_RUN = range(8)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
LANE = 64
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
               8232, 8233, 8239, 8287, 12288)


@functools.cache
def codepoint_classes() -> np.ndarray:
    of = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    t[list(WHITE_SPACE)] = WHITE
    t[32], t[ord("'")] = SPACE, APOSTROPHE
    for letters, k in (("stmd", ONE), ("rv", RV), ("l", EL), ("e", EE)):
        t[[ord(x) for x in letters]] = k
    return t


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and token start by (class, state); classes 8-15 are the same
    at the first code point of a text, where any state counts as closed."""
    goes, starts = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    body = {C_LETTER: IN_LETTERS, C_NUMBER: IN_NUMBERS, C_OTHER: IN_OTHER}
    for s in range(8):
        for c in range(8):
            if s == TWO_LEFT:
                to, new = ONE_LEFT, False
            elif s == ONE_LEFT:
                to, new = CLOSED, False
            elif c in body:
                to, new = body[c], s not in (body[c], JOINING)
            elif c in (C_SHORT, C_LONG):
                to, new = (IN_OTHER, False) if s in (IN_OTHER, JOINING) else (ONE_LEFT if c == C_SHORT else TWO_LEFT, True)
            elif c == C_JOIN:
                to, new = JOINING, True
            elif c == C_ALONE:
                to, new = CLOSED, True
            else:
                to, new = IN_WHITE, s != IN_WHITE
            goes[c, s], starts[c, s] = to, new
    goes[8:], starts[8:] = goes[:8, CLOSED, None], starts[:8, CLOSED, None]
    return goes, starts


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a pre-token begins.  ``text_starts``: the first code points of
    the texts that ``points`` holds one after another (no empty ones)."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    raw = codepoint_classes()[points]
    end = np.uint8(255)
    last = np.append(text_starts[1:], n) - 1
    after = np.append(raw[1:], end)
    after[last] = end
    after2 = np.append(after[1:], end)
    after2[last] = end
    c = np.full(n, C_LETTER, np.uint8)
    c[raw == NUMBER] = C_NUMBER
    c[raw == OTHER] = C_OTHER
    white, more = (raw == SPACE) | (raw == WHITE), (after == SPACE) | (after == WHITE) | (after == end)
    c[white] = C_RUN
    c[white & ~more] = C_ALONE
    c[(raw == SPACE) & ~more] = C_JOIN
    mark = raw == APOSTROPHE
    c[mark] = C_OTHER
    c[mark & (after == ONE)] = C_SHORT
    c[mark & (((after == RV) & (after2 == EE)) | ((after == EL) & (after2 == EL)))] = C_LONG
    c[text_starts] += 8
    goes, starts = automaton()
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.uint8)
    grid[:n] = c
    grid = grid.reshape(lanes, LANE)
    flat = goes.ravel()
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8)).copy()
    for k in range(LANE):                                      # each lane's composed function
        f = flat[(grid[:, k].astype(np.intp) * 8)[:, None] + f]
    step = 1
    while step < lanes:                                        # inclusive scan over lanes
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        f, step = g, step * 2
    state = np.concatenate([[CLOSED], f[:-1, CLOSED]]).astype(np.intp)
    out, begins = np.empty((lanes, LANE), bool), starts.ravel()
    for k in range(LANE):
        at = grid[:, k].astype(np.intp) * 8 + state
        out[:, k] = begins[at]
        state = flat[at].astype(np.intp)
    return out.ravel()[:n]


def pretoken_slices(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pre-tokens of the texts in ``data`` (an end offset
    more than tokens), and how many of them lie before each text's end."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))
    at = np.concatenate([[0], at])
    heads = np.unique(np.searchsorted(at, offs[:-1][offs[1:] > offs[:-1]]))
    cuts = np.append(at[:-1][token_starts(points, heads)], at[-1])
    return cuts, np.searchsorted(cuts[:-1], offs[1:], side="left")


class Tokeniser:
    """Ranks file -> cached encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = (line.split() for line in f if line.strip())
            self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.pairs = ragged_bpe.pair_table({p: r for p, r in self.ranks.items() if len(p) > 1}, self.ranks)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache = ragged_bpe.Cache(self._encode)
        n = max(self.ranks.values()) + 1
        table = [b""] * n
        for p, r in self.ranks.items():
            table[r] = p
        self.size = np.array([len(p) for p in table], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Each pre-token's ids as little-endian 32-bit numbers; a whole
        pre-token that is itself a token is that token."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ids, kept = ragged_bpe.merge(sym, lens, self.pairs)
        blob, ends = ids.astype("<u4").tobytes(), (np.cumsum(kept) * 4).tolist()
        out, a = [], 0
        for w, b in zip(words, ends):
            whole = self.ranks.get(w)
            out.append(blob[a:b] if whole is None else whole.to_bytes(4, "little"))
            a = b
        return out

    def encode_chunk(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        cuts, upto = pretoken_slices(data, offs)
        raw, edges = data.tobytes(), cuts.tolist()
        words = [raw[a:b] for a, b in zip(edges, edges[1:])]
        self.cache.learn(set(words))
        get, a, out = self.cache.__getitem__, 0, []
        for b in upto.tolist():
            out.append(b"".join(map(get, words[a:b])))
            a = b
        return out

    def decode(self, blob: bytes) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, and the byte offset of each id."""
        ids = np.frombuffer(blob, "<u4").astype(np.int64)
        size = self.size[ids]
        offsets = np.cumsum(size) - size
        total = int(size.sum())
        take = np.repeat(self.first[ids] - offsets, size) + np.arange(total)
        return self.bytes[take].tobytes(), offsets


@functools.lru_cache(maxsize=2)
def tokeniser(path: str) -> Tokeniser:
    return Tokeniser(path)


def _map(docs: DataFrame, path: str, text_col: str, new: list[tuple[str, T.DataType, pa.DataType]], work) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [n for n, _, _ in new]
    old = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    keep = [f.name for f in old]
    out = T.StructType([*old, *(T.StructField(n, t) for n, t, _ in new)])
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias(*unique_name(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokeniser(path)
        for b in batches:
            data, offs = utf8_buffer(b.column(b.num_columns - 1))
            for i, j in row_groups(offs):
                part = b.slice(i, j - i)
                cols = work(tok, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(cols, new))], names=keep + names)

    return src.mapInArrow(run, out)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the token ids of each text (array of ints)."""
    def work(tok, data, offs):
        blobs = tok.encode_chunk(data, offs)
        ends = np.cumsum([0, *(len(x) // 4 for x in blobs)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))]
    return _map(docs, path, text_col, [(ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], work)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", offsets_col: str = "offsets") -> DataFrame:
    """``docs`` with the bytes that ``ids_col`` stands for (binary) and each
    token's byte offset; null ids give no bytes."""
    bounded_batches(docs.sparkSession)
    old = [f for f in docs.schema.fields if f.name.lower() not in {out_col.lower(), offsets_col.lower()}]
    keep = [f.name for f in old]
    out = T.StructType([*old, T.StructField(out_col, T.BinaryType()), T.StructField(offsets_col, T.ArrayType(T.LongType()))])
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{ids_col}`"].alias(*unique_name(docs, "ids")))

    def run(batches):
        tok = tokeniser(path)
        for b in batches:
            got = [tok.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.binary()),
                                              pa.array([o for _, o in got], pa.list_(pa.int64()))], names=[*keep, out_col, offsets_col])

    return src.mapInArrow(run, out)


def digests(docs: DataFrame, path: str, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (of the bytes that
    the ids decode to), and with the ids themselves if ``ids_col`` names them."""
    def work(tok, data, offs):
        blobs = tok.encode_chunk(data, offs)
        out = [[len(x) // 4 for x in blobs], [hashlib.sha256(x).hexdigest() for x in blobs],
               [hashlib.sha256(tok.decode(x)[0]).hexdigest() for x in blobs]]
        if ids_col:
            out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *out[0]]), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4"))))
        return out
    s = T.StringType()
    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", s, pa.string()), ("decoded_sha256", s, pa.string())]
    if ids_col:
        new.append((ids_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    return _map(docs, path, text_col, new, work)
