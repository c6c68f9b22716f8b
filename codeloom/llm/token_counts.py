"""Operator 6: token counts by rank-synchronous array merging.

Texts are cut before every space that follows another character (no piece of
the vocabulary holds a space mark after another character, which is checked, so
no merge crosses such a cut).  Pre-tokens not met before are held as ragged
arrays of symbols; each round every sequence applies its lowest-rank pair
(``ragged_bpe``), and the surviving symbols are counted, a character outside the
vocabulary as its UTF-8 bytes (byte fallback).

Defined results: null text counts as empty (0 bytes, 0 tokens); all rows stay,
repeated ones and null ids too; extra columns stay, those named like a result
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeloom.llm import ragged_bpe
from codeloom.llm.common import bounded_batches, row_groups, unique_name, utf8_buffer

MARK = "▁"  # stands for a space
CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


class PieceModel:
    """Pieces, merge order and byte ids of a sentence-piece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("unused pieces are not supported")
        if [sp.id_to_piece(i) for i in sp.encode("a  b ")] and sp.decode(sp.encode("a  b ")) != "a  b ":
            raise ValueError("models that drop white space are not supported")
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a word's start")
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        level = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.ids = dict(pieces)
        self.n_vocab = n
        for c in sorted({c for p in pieces for c in p} - set(pieces)):
            self.ids[c] = n + len(self.ids)                    # a symbol, but no piece by itself
        self.byte0 = sp.piece_to_id("<0x00>")
        self.pairs = ragged_bpe.pair_table({p: level[s] for p, s in score.items() if len(p) > 1}, self.ids)
        top = max(self.ids.values()) + 1                       # top + k: an unknown character of k bytes
        points = np.arange(0x110000)
        self.by_point = (top + _utf8_size(points)).astype(np.int32)
        self.points, self.tokens_of = np.ones(top + 5, np.int64), np.ones(top + 5, np.int64)
        self.tokens_of[top:] = np.arange(5)
        for s, i in self.ids.items():
            self.points[i] = len(s)
            if i >= n:
                self.tokens_of[i] = len(s.encode())
            if len(s) == 1:
                self.by_point[ord(s)] = i
        self.counts = ragged_bpe.Cache(self.count)
        self.tokens = ragged_bpe.Cache(self.encode)

    def _merged(self, words: list[str]):
        """Code points, surviving symbols and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        return points, *ragged_bpe.merge(self.by_point[points], lens, self.pairs)

    def _sizes(self, sym, kept):
        """Tokens of each symbol (bytes of one outside the vocabulary) and word."""
        size = self.tokens_of[sym]
        ends = np.cumsum(size)[np.cumsum(kept) - 1] if len(sym) else np.zeros(len(kept), np.int64)
        return size, ends

    def count(self, words: list[str]) -> list[int]:
        _, sym, kept = self._merged(words)
        return np.diff(self._sizes(sym, kept)[1], prepend=0).tolist()

    def encode(self, words: list[str]) -> list[bytes]:
        """Each pre-token's ids as little-endian 32-bit numbers."""
        points, sym, kept = self._merged(words)
        size, ends = self._sizes(sym, kept)
        ids = np.repeat(sym, size)
        lone = np.flatnonzero(sym >= self.n_vocab)
        if len(lone):                                          # spelled as their UTF-8 bytes
            width, at = size[lone], (np.cumsum(size) - size)[lone]
            p = points[(np.cumsum(self.points[sym]) - self.points[sym])[lone]].astype(np.int64)
            for k in range(4):
                has = width > k
                low = (p[has] >> (6 * (width[has] - 1 - k))) & 0x3F
                head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[has]] | (p[has] >> (6 * (width[has] - 1)))
                ids[at[has] + k] = self.byte0 + (head if k == 0 else 0x80 | low)
        blob, out, a = ids.astype("<u4").tobytes(), [], 0
        for b in (ends * 4).tolist():
            out.append(blob[a:b])
            a = b
        return out

    @staticmethod
    def pretokens(text: str) -> list[str]:
        return CUT.findall(MARK + text.replace(" ", MARK)) if text else []


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    bounded_batches(docs.sparkSession)
    names = ["n_bytes", "n_tokens", "over_limit"]
    old = [f for f in docs.schema.fields if f.name.lower() not in names]
    keep = [f.name for f in old]
    out = T.StructType([*old, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias(*unique_name(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            _, offs = utf8_buffer(texts)
            for i, j in row_groups(offs):
                words = [model.pretokens(t or "") for t in texts.slice(i, j - i).to_pylist()]
                model.counts.learn(set().union(*words))
                get = model.counts.__getitem__
                n = np.array([sum(map(get, w)) for w in words], np.int64)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:-1], pa.array(np.diff(offs[i: j + 1])), pa.array(n), pa.array(n > limit)], names=keep + names)

    return src.mapInArrow(run, out)
