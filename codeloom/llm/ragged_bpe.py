"""Byte-pair merging over ragged numpy arrays.

Many pre-tokens are held as one flat array of symbol ids plus sequence numbers.
In every round each sequence applies its lowest-rank pair; rounds go on until no
sequence has a pair left.  A sequence merges all places of its pair in a round
if no pair that such a merge creates (also between two neighbouring places)
ranks at or before it, and else only the leftmost one, so the result is that of
merging one pair at a time, lowest rank first, leftmost first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np

NONE = np.int64(1) << np.int64(62)


class PairTable:
    """(left id, right id) -> (rank, merged id), open addressing in arrays."""

    def __init__(self, left, right, rank, merged):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int64)
        self.merged = np.zeros(1 << bits, np.int32)
        rank, merged = np.asarray(rank, np.int64), np.asarray(merged, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]           # the last writer of a slot stays
            won = self.keys[slot] == keys[todo]
            self.rank[slot[won]], self.merged[slot[won]] = rank[todo[won]], merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Ranks (NONE where there is no such pair) and merged ids."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        got = self.keys[slot]
        miss = np.flatnonzero((got != keys) & (got != -1))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            got = self.keys[slot[miss]]
            miss = miss[(got != keys[miss]) & (got != -1)]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


def pair_table(order: dict, ids: dict) -> PairTable:
    """Every split of every piece into two known symbols is a pair; its rank is
    the piece's.  ``order``: piece -> rank, ``ids``: symbol -> id."""
    left, right, rank, merged = [], [], [], []
    for piece, r in order.items():
        m = ids[piece]
        for k in range(1, len(piece)):
            a, b = ids.get(piece[:k]), ids.get(piece[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(r)
                merged.append(m)
    return PairTable(left, right, rank, merged)


def merge(sym: np.ndarray, lens: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols, flat and in sequence order, and how many each sequence kept."""
    n = len(lens)
    first = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    out, kept = np.zeros(len(sym), np.int32), np.zeros(n, np.int64)
    sym = sym.astype(np.int32)
    seq = np.repeat(np.arange(n), lens)
    rank, into = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int32)
    at = np.flatnonzero(seq[1:] == seq[:-1]) if len(sym) else np.zeros(0, np.int64)
    rank[at], into[at] = pairs.find(sym[at], sym[at + 1])
    while len(sym):
        new = np.concatenate([[True], seq[1:] != seq[:-1]])
        begin = np.flatnonzero(new)
        local = np.cumsum(new) - 1
        best = np.minimum.reduceat(rank, begin)
        done = best == NONE
        if done.any():
            end = done[local]
            which = seq[begin[done]]
            size = np.diff(np.append(begin, len(sym)))[done]
            kept[which] = size
            out[np.repeat(first[which], size) + _ramp(size)] = sym[end]
            sym, seq, rank, into = sym[~end], seq[~end], rank[~end], into[~end]
            if not len(sym):
                break
            if done.all():
                break
            new = np.concatenate([[True], seq[1:] != seq[:-1]])
            begin, local, best = np.flatnonzero(new), np.cumsum(new) - 1, best[~done]
        at = np.flatnonzero(rank == best[local])               # all places of the lowest rank
        own = local[at]
        lead = np.concatenate([[True], own[1:] != own[:-1]])
        several = np.bincount(own, minlength=len(begin)) > 1
        if several.any():
            at = _together(sym, seq, into, best, local, at, own, lead, several, pairs)
        else:
            at = at[lead]
        sym[at] = into[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))                        # its place after the removals before it
        sym, seq, rank, into = sym[stay], seq[stay], rank[stay], into[stay]
        again = np.concatenate([moved, moved[moved > 0] - 1])
        inside = again + 1 < len(sym)
        inside[inside] = seq[again[inside]] == seq[again[inside] + 1]
        rank[again[~inside]] = NONE
        again = again[inside]
        rank[again], into[again] = pairs.find(sym[again], sym[again + 1])
    keep = np.repeat(first, kept) + _ramp(kept)
    return out[keep], kept


def _ramp(size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size)


def _together(sym, seq, into, best, local, at, own, lead, several, pairs):
    """The places to merge in this round: all that do not overlap, or the first."""
    head = at[lead]                                            # the leftmost place of each sequence
    same = into[at] == into[head][np.cumsum(lead) - 1]
    at, own = at[same], own[same]
    run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    pick = nth % 2 == 0                                        # of overlapping places each second one
    at, own = at[pick], own[pick]
    check = several[own]
    c, o = at[check], own[check]
    ab = into[c]
    bad = np.zeros(len(best), bool)
    r, _ = pairs.find(ab, ab)
    bad[o[r <= best[o]]] = True
    left = np.flatnonzero((c > 0) & (seq[np.maximum(c - 1, 0)] == seq[c]))
    r, _ = pairs.find(sym[c[left] - 1], ab[left])
    bad[o[left[r <= best[o[left]]]]] = True
    right = np.flatnonzero(c + 2 < len(sym))
    right = right[seq[c[right] + 2] == seq[c[right]]]
    r, _ = pairs.find(ab[right], sym[c[right] + 2])
    bad[o[right[r <= best[o[right]]]]] = True
    lead = np.concatenate([[True], own[1:] != own[:-1]])
    return at[lead | ~bad[own]]


class Cache(dict):
    """Bounded memo from a pre-token to what ``encode`` makes of it; a full memo
    forgets its older half, so a task's memory does not follow its input."""

    def __init__(self, encode: Callable[[list], Iterable], entries: int = 800_000):
        super().__init__()
        self.encode, self.entries = encode, entries

    def learn(self, words: set, step: int = 50_000) -> None:
        """Make every one of ``words`` known."""
        if len(self) > self.entries:
            for w in list(islice(self, len(self) // 2)):
                del self[w]
        todo = [w for w in words if w not in self]
        for i in range(0, len(todo), step):
            part = todo[i: i + step]
            self.update(zip(part, self.encode(part)))
