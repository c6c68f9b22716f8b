"""Operator 5: removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of ``length`` bytes covers it that starts anywhere else
too.  That is so for a start whose suffix shares ``length`` bytes with another
one, hence with a neighbour in suffix order.  Suffixes are sorted one bucket at
a time; only buckets that hold a repeat can matter.

1. Bucket keys.  Of the grams in the ``length`` bytes at a start, the one with
   the least hash (the last of equal ones) is the start's anchor; equal strings
   have equal anchors at equal distance.  Consecutive starts share an anchor, so
   a bucket's text is one window ("context") per anchor, not a copy per suffix.
   Anchors are counted by their gram; grams found once end here.
2. Contexts are counted by content.  Copies are one context; its starts are all
   repeated.  Text goes on only for grams with several different contexts, one
   copy of each.
3. Each bucket is sorted by itself: by the first 32 bytes, then ties, which may
   be as long as the text, by the ranks of the next two suffixes at equal
   distance that lie in the difference cover (positions whose remainder modulo
   31 is in a perfect difference set; there is such a distance below 31 for any
   two).  These ranks are computed beforehand for the bucket by doubling over
   the sample only.  Neighbours then are compared over ``length`` bytes.
   A gram with very many contexts is split over buckets by a salt, and its
   distinct heads meet again in a grouped count.
4. Spans go back to their texts, all copies of a text alike.

Defined results: null text counts as empty; texts shorter than ``length`` keep
all; equal rows and equal texts are occurrences of each other; null ids stay;
columns named like a result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, materialize, mix64, utf8_buffer

GRAM = 128
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: Bytes of context in a bucket; a gram with more than that is split by a salt.
BUCKET_BYTES = 6 << 20


# --- anchors ---------------------------------------------------------------

@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(SEGMENT + 1, BASE, np.uint64), np.full(SEGMENT + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_keys(x: np.ndarray, gram: int) -> np.ndarray:
    """Per position: hash of its gram in the upper 44 bits, then how far it lies
    from the segment's end, so that the least key is the last of equal grams."""
    up, down = _powers()
    n = len(x) - gram + 1
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], dtype=np.uint64, out=total[1:])
    h = mix64((total[gram:] - total[:-gram]) * down[:n])
    return (h & ~np.uint64(SEGMENT - 1)) | (np.uint64(SEGMENT - 1) - np.arange(n, dtype=np.uint64))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(x)
    grid = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    grid[:n] = x
    grid = grid.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1: n])


def segments(offs: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of pieces (text, from, to) of together at most SEGMENT bytes; a
    longer text is cut into pieces that overlap by ``length`` - 1 bytes."""
    group, size = [], 0
    for r in np.flatnonzero(np.diff(offs) >= length).tolist():
        n, at = int(offs[r + 1] - offs[r]), 0
        while n - at >= length:
            take = min(n - at, SEGMENT)
            if size + take > SEGMENT:
                yield group
                group, size = [], 0
            group.append((r, at, at + take))
            size += take
            if at + take == n:
                break
            at += take - length + 1
    if group:
        yield group


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(cls, ctx, tk, n, lo, hi) from (tk, n, text): for each anchor the hash of
    its gram, of its context, its text's key and size, its first and last start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h64

        for b in batches:
            tk, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offs = utf8_buffer(b.column(2))
            for group in segments(offs, length):
                x = np.concatenate([data[offs[r] + p: offs[r] + q] for r, p, q in group])
                size = np.array([q - p for _, p, q in group])
                begin = np.cumsum(size) - size
                if len(x) < length:
                    continue
                best = window_min(gram_keys(x, gram), length - gram + 1)
                at = SEGMENT - 1 - (best & np.uint64(SEGMENT - 1)).astype(np.int64)
                piece = np.repeat(np.arange(len(group)), size)[: len(at)]
                valid = np.arange(len(at)) <= (begin + size - length)[piece]
                cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])]))
                last = np.append(cut[1:], len(at)) - 1
                ok = valid[cut]
                cut, last = cut[ok], last[ok]
                where = at[cut]
                raw = x.tobytes()
                cls = [h64(raw[a: a + gram]) for a in where.tolist()]
                ctx = [h64(raw[a:z]) for a, z in zip(cut.tolist(), (last + length).tolist())]
                own = piece[cut]
                row = np.array([r for r, _, _ in group])[own]
                move = np.array([p for _, p, _ in group])[own] - begin[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)),
                                                  pa.array(tk[row]), pa.array(n[row]), pa.array(cut + move), pa.array(last + move)],
                                                 names=["cls", "ctx", "tk", "n", "lo", "hi"])

    return texts.mapInArrow(run, "cls long, ctx long, tk long, n long, lo long, hi long")


# --- one bucket ------------------------------------------------------------

@functools.cache
def cover_shift() -> np.ndarray:
    """By the remainders of two positions: the least distance at which both are
    in the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in reversed(range(PERIOD)):
        hit = np.roll(inside, -d)
        out[np.ix_(hit, hit)] = d
    if (out < 0).any():
        raise ValueError("not a difference cover")
    return out


def cover_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks, by position, of the suffixes at cover positions, over ``depth``
    bytes at least (0 past the end)."""
    residues = np.array(COVER)
    pos = (np.arange(-(-n // PERIOD))[:, None] * PERIOD + residues).ravel()
    pos = pos[pos < n]
    rank = np.zeros(n + 2 * depth + 2 * PERIOD, np.int64)
    rank[pos] = 1 + _dense([words[pos + 8 * k] for k in range(4)])
    step, reach = PERIOD, 32
    while reach < depth:
        rank[pos] = 1 + _dense([rank[pos], rank[pos + step]])
        reach, step = reach + step, step * 2
    return rank


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Dense rank of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _network(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Comparators of an odd-even merge sort, stage by stage."""
    p = 1
    while p < size:
        k = p
        while k >= 1:
            a = np.arange(size - k)
            off = a - k % p
            a = a[(off >= 0) & (off % (2 * k) < k) & (a // (2 * p) == (a + k) // (2 * p))]
            yield a, a + k
            k //= 2
        p *= 2


def sort_ties(suffix: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> None:
    """Sort each run of ``suffix`` (runs share their first 32 bytes) in place by
    the cover ranks; all runs of a size class go through one sorting network."""
    shift = cover_shift()
    first = np.cumsum(sizes) - sizes
    for bits in range(1, int(sizes.max()).bit_length() + 1):
        width = 1 << bits
        runs = np.flatnonzero((sizes > width // 2) & (sizes <= width) & (sizes > 1))
        per = max(1, (1 << 21) // width)
        for k in range(0, len(runs), per):
            r = runs[k: k + per]
            lane = np.arange(width)
            at = first[r][:, None] + lane
            real = lane < sizes[r][:, None]
            m = np.where(real, suffix[np.minimum(at, len(suffix) - 1)], -1)
            for a, b in _network(width):
                x, y = m[:, a], m[:, b]
                d = shift[x % PERIOD, y % PERIOD]
                swap = ((x < 0) & (y >= 0)) | ((x >= 0) & (y >= 0) & (rank[x + d] > rank[y + d]))
                m[:, a], m[:, b] = np.where(swap, y, x), np.where(swap, x, y)
            suffix[at[real]] = m[real]


def sorted_heads(data: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and which of them share their first
    ``length`` bytes with the one before."""
    n = len(data)
    padded = data + bytes(2 * length + 64)
    words = np.ndarray((n + length + 48,), ">u8", padded, 0, (1,))
    heads = [words[starts + 8 * k].astype(np.uint64) for k in range(4)]
    order = np.lexsort(heads[::-1])
    suffix = starts[order]
    tie = np.zeros(len(order), bool)
    if len(order):
        tie[1:] = True
        for h in heads:
            s = h[order]
            tie[1:] &= s[1:] == s[:-1]
    if not tie.any():
        return suffix, tie
    sizes = np.diff(np.flatnonzero(np.append(~tie, True)))
    rank = cover_ranks(words, n, length + PERIOD)
    sort_ties(suffix, sizes, rank)
    at = np.flatnonzero(tie)
    for o in [length - 8, length // 2, *range(32, length - 8, 8)]:
        at = at[words[suffix[at] + o] == words[suffix[at - 1] + o]]
    same = np.zeros(len(order), bool)
    same[at] = True
    return suffix, same


def bucket_repeats(table: pa.Table, length: int) -> pa.Table:
    """Per bucket: start ranges (a, b) of contexts found once whose heads repeat,
    and for split grams the digests of all distinct heads."""
    from xxhash import xxh3_128_digest as h128

    blobs = table.column("bytes").to_pylist()
    cls, ctx = table.column("cls").to_numpy(), table.column("ctx").to_numpy()
    once, split = table.column("once").to_numpy(zero_copy_only=False), table.column("split").to_numpy(zero_copy_only=False)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begin, count = np.cumsum(size) - size, size - length + 1
    owner = np.repeat(np.arange(len(blobs)), count)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
    data = b"".join(blobs)
    suffix, same = sorted_heads(data, starts, length)
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    out = {c: [] for c in ("cls", "ctx", "a", "b", "head")}
    hit = np.zeros(len(data) + 1, bool)
    hit[suffix[repeated]] = True
    hit &= np.append(np.repeat(once, size), False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for c in range(int(np.searchsorted(begin, x, side="right")) - 1, int(np.searchsorted(begin, y - 1, side="right"))):
            p, q = max(x, begin[c]) - begin[c], min(y, begin[c] + size[c]) - 1 - begin[c]
            for k, v in zip(out, (cls[c], ctx[c], int(p), int(q), None)):
                out[k].append(v)
    if split.any():
        back = np.zeros(len(data), np.int64)
        back[starts] = owner
        for s, r in zip(suffix[~same].tolist(), repeated[~same].tolist()):
            c = back[s]
            if split[c]:
                lone = not r and once[c]
                for k, v in zip(out, (cls[c], ctx[c] if lone else None, int(s - begin[c]) if lone else None, None, h128(data[s: s + length]))):
                    out[k].append(v)
    long = pa.int64()
    return pa.table({"cls": pa.array(out["cls"], long), "ctx": pa.array(out["ctx"], long), "a": pa.array(out["a"], long), "b": pa.array(out["b"], long),
                     "head": pa.array(out["head"], pa.binary())})


# --- the whole -------------------------------------------------------------

def repeated_starts(keyed: DataFrame, length: int = 400, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES):
    """From (tk, n, text and more columns): the table of texts, with their text
    only where it may lose bytes, and (tk, n, starts) with all repeated starts
    as ranges (lo, hi)."""
    anc = materialize(anchors(keyed.filter(F.col("n") >= length).select("tk", "n", "text"), length, gram), "anchors")
    more = materialize(anc.groupBy("cls").agg(F.count("*").alias("c"), (F.min("ctx") != F.max("ctx")).alias("several")).filter("c > 1").select("cls", "several"), "repeated-grams")
    # written before it is grouped: adaptive execution can then split the join at a hot gram
    hits = materialize(materialize(anc.join(more, "cls"), "anchor-matches").groupBy("cls", "ctx", "tk", "n", "lo", "hi").agg(F.count("*").alias("c"), F.first("several").alias("several")), "anchor-hits")
    contexts = materialize(hits.groupBy("cls", "ctx").agg(F.sum("c").alias("c"), F.first("several").alias("several"), F.min(F.struct("tk", "n", "lo", "hi")).alias("at")), "contexts")
    per_gram = materialize(contexts.filter("several").groupBy("cls").agg(F.ceil(F.sum(F.col("at.hi") - F.col("at.lo") + length) / bucket_bytes).alias("salts")), "gram-salts")
    ship = contexts.filter("several").join(per_gram, "cls").select(
        F.col("at.tk").alias("tk"), F.col("at.n").alias("n"),
        F.struct("cls", "ctx", "at.lo", "at.hi", (F.col("c") == 1).alias("once"), (F.col("salts") > 1).alias("split"), F.pmod("ctx", "salts").alias("salt")).alias("w"))
    wanted = materialize(hits.select("tk", "n", F.lit(None).cast(ship.schema["w"].dataType).alias("w")).distinct().unionByName(ship)
                         .groupBy("tk", "n").agg(F.collect_list("w").alias("w")), "wanted-contexts")
    had = [c for c in keyed.columns if c != "text"]
    texts = materialize(keyed.join(wanted, ["tk", "n"], "left").select(
        *had, "w", F.when(F.col("w").isNotNull(), F.col("text")).alias("text"),
        F.when(F.col("w").isNull(), F.sha2("text", 256)).alias("sha")), "texts")

    total = contexts.filter("several").agg(F.sum(F.col("at.hi") - F.col("at.lo") + length)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8_buffer(b.column(0))
            for r, wants in enumerate(b.column(1).to_pylist()):
                t = data[offs[r]: offs[r + 1]].tobytes()
                for i in range(0, len(wants), 5000):
                    part = wants[i: i + 5000]
                    col = lambda k: pa.array([w[k] for w in part])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([col("cls"), col("ctx"), col("once"), col("split"), pa.array([w["salt"] for w in part], pa.int64()),
                                                      pa.array([t[w["lo"]: w["hi"] + length] for w in part], pa.binary())],
                                                     names=["cls", "ctx", "once", "split", "salt", "bytes"])

    def sort_bucket(table):
        return bucket_repeats(table, length)

    one = texts.filter(F.size("w") > 0).groupBy("tk", "n").agg(F.first("text").alias("text"), F.first("w").alias("w"))
    windows = one.select("text", "w").mapInArrow(cut, "cls long, ctx long, once boolean, split boolean, salt long, bytes binary")
    found = materialize(windows.withColumn("bucket", F.pmod(F.xxhash64("cls", "salt"), F.lit(buckets))).groupBy("bucket")
                        .applyInArrow(sort_bucket, "cls long, ctx long, a long, b long, head binary"), "bucket-repeats")
    heads = found.filter("head is not null")
    twice = materialize(heads.groupBy("cls", "head").agg(F.count("*").alias("c")).filter("c > 1").select("cls", "head"), "split-heads")
    ranges = (found.filter("head is null").select("cls", "ctx", "a", "b")
              .unionByName(heads.filter("ctx is not null").join(twice, ["cls", "head"]).select("cls", "ctx", "a", F.col("a").alias("b")))
              .groupBy("cls", "ctx").agg(F.collect_list(F.struct("a", "b")).alias("part")))
    known = materialize(contexts.filter("c > 1").select("cls", "ctx", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("part"))
                        .unionByName(ranges), "context-repeats")
    back = hits.join(known, ["cls", "ctx"]).select("tk", "n", F.explode(
        F.coalesce(F.transform("part", lambda p: F.struct((F.col("lo") + p["a"]).alias("lo"), (F.col("lo") + p["b"]).alias("hi"))), F.array(F.struct("lo", "hi")))).alias("s"))
    return texts, materialize(back.groupBy("tk", "n").agg(F.collect_list("s").alias("starts")), "repeated-starts")


def _runs(starts: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the strings at these start ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["lo"], s["hi"] + length) for s in starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` without its text, with n_bytes, spans (removed runs, as byte
    offsets) , n_removed, n_spans and kept_sha256 (of the bytes that stay)."""
    bounded_batches(docs.sparkSession)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    names = [c for c in docs.columns if c != text_col and c.lower() not in new]
    keep = [f"k{i}" for i in range(len(names))]                # under way, so that no name clashes
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    keyed = docs.select(*[docs[f"`{c}`"].alias(k) for c, k in zip(names, keep)], F.xxhash64(text).alias("tk"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    texts, starts = repeated_starts(keyed, length, gram, bucket_bytes)
    run_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    plain = texts.filter("text is null").select(*[F.col(f"`{c}`") for c in keep], F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                                F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast(run_type).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns
            data, offs = utf8_buffer(b.column(k - 2))
            runs = [_runs(s or [], length) for s in b.column(k - 1).to_pylist()]
            sha = []
            for r, rs in enumerate(runs):
                h, at = hashlib.sha256(), int(offs[r])
                for x, y in rs:
                    h.update(data[at: offs[r] + x])
                    at = int(offs[r]) + y
                h.update(data[at: offs[r + 1]])
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: k - 2], pa.array([sum(y - x for x, y in rs) for rs in runs], pa.int64()),
                                              pa.array([len(rs) for rs in runs], pa.int64()), pa.array(sha, pa.string()),
                                              pa.array([[{"start": x, "stop": y} for x, y in rs] for rs in runs], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                                             names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    some = (texts.filter("text is not null").join(starts, ["tk", "n"], "left")
            .select(*[F.col(f"`{c}`") for c in keep], F.col("n").alias("n_bytes"), "text", "starts"))
    out = plain.unionByName(some.mapInArrow(cut, plain.schema))
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, keep)], *new)
