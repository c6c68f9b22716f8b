"""Operator 4: benchmark decontamination by latent semantic retrieval and sequence checks.

1. Words are lower-cased runs between white space and ASCII punctuation.  The
   vocabulary is the benchmark's own words (others add nothing to a product with
   a benchmark vector); their document frequencies come from all documents.
2. A randomised SVD of the TF-IDF matrix of the benchmark's passages and those
   of all documents.  Tasks add up the products of the words that share a passage;
   the sums, one for each pair of vocabulary words at most, are a written table
   over which the passes run: tasks multiply its rows with the sketch, the driver
   orthonormalises a matrix of vocabulary times rank.
3. Each document gives windows of 24 words at a stride of 8, projected as sums of
   blocks of 8 words.  All windows are compared, those of little TF-IDF energy
   too: a paraphrase may replace an item's rare words first.  Benchmark probes of
   16 words (16 words always lie within one window) are compared by cosine; a bound
   for each group of probes spares products that cannot reach the cosine
   (``similar``).  The probes are a
   stated query set and go out in blocks of ``block_items`` items.
4. A candidate's surrounding words and the item go through a longest common
   subsequence: a leak has ``lcs_min`` of the item's words in order, or, for
   paraphrases, ``paraphrase_min`` of them and the words of its answer (what
   follows ``answer:``, else its last sentence) in order too.

Defined results: one row per document row and leaked item; null and empty texts
leak nothing; items of under ``MIN_WORDS`` words are not searched by these steps
but matched as contiguous words (cosine null, share 1); repeated document rows give repeated results; repeated item
ids count as one item each; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, materialize, row_groups, utf8_buffer

BLOCK, WINDOW_BLOCKS, PROBE, MIN_WORDS = 8, 3, 16, 8
#: Probes that share one bound.
GROUP = 8
#: ASCII punctuation separates words like white space does.
_PUNCT = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_CHUNK = 512 << 10


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_PUNCT).split()


def answer_of(text: str) -> list[bytes]:
    """The item's answer: after its last ``answer:``, else its last sentence."""
    at = text.lower().rfind("answer:")
    if at >= 0:
        return words_of(text[at + 7:])
    parts = [w for w in map(words_of, re.split(r"[.!?\n]+", text)) if w]
    return parts[-1] if parts else []


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = place.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items as vocabulary numbers."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[bytes, int]
    sets: list[frozenset[int]]

    @staticmethod
    def of(rows) -> Items:
        vocabulary: dict[bytes, int] = {}
        number = lambda ws: [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        ids, words, answers = [], [], []
        for r in rows:
            ws = number(words_of(r["text"] or ""))
            if len(ws) >= MIN_WORDS:
                ids.append(r["item_id"])
                words.append(ws)
                answers.append(number(answer_of(r["text"])))
        return Items(ids, words, answers, vocabulary, [frozenset(ws) for ws in words])

    def probes(self) -> list[tuple[int, int, list[int]]]:
        """(item, first word, words): pieces of PROBE words, the last one aligned to the end."""
        out = []
        for k, ws in enumerate(self.words):
            starts = [*range(0, max(1, len(ws) - PROBE + 1), PROBE)]
            if len(ws) > PROBE and starts[-1] + PROBE < len(ws):
                starts.append(len(ws) - PROBE)
            out += [(k, s, ws[s: s + PROBE]) for s in starts]
        return out


def _numbers(texts: list, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    none, get = len(vocabulary), vocabulary.get
    each = map(words_of, (t or "" for t in texts))
    return [np.fromiter(map(get, ws, repeat(none)), np.int32, len(ws)) for ws in each]


def _texts(batches: Iterator[pa.RecordBatch], col: int):
    """(batch, first row, last row, texts) in chunks of a bounded size."""
    for b in batches:
        c = b.column(col)
        for i, j in row_groups(utf8_buffer(c)[1], _CHUNK):
            yield b, i, j, c.slice(i, j - i).to_pylist()


def document_frequencies(numbers: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word, and how many documents there are."""
    def count(batches):
        total, rows = np.zeros(n_words + 1, np.int64), 0
        for b in batches:
            rows += len(b)
            for x in b.column(0).to_pylist():
                total[np.unique(np.frombuffer(x, "<i4"))] += 1
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], names=["word", "n"])

    got = numbers.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(n_words), 0
    for r in got:
        if r["word"] < 0:
            n = int(r["n"])
        else:
            df[r["word"]] = r["n"]
    return df, n


def project_blocks(flat: np.ndarray, project: np.ndarray, step: int = 256) -> np.ndarray:
    """Sum of the projected words of each block, a few blocks at a time so that
    what is added stays in the processor's cache."""
    words = flat.reshape(-1, BLOCK)
    out = np.zeros((len(words), project.shape[1]), np.float32)
    held = np.empty((step, project.shape[1]), np.float32)
    for a in range(0, len(words), step):
        sums = out[a: a + step]
        row = held[: len(sums)]
        for c in range(BLOCK):
            np.take(project, words[a: a + step, c], axis=0, out=row, mode="clip")
            sums += row
    return out


def _window_sums(blocks: np.ndarray) -> np.ndarray:
    n = len(blocks) - WINDOW_BLOCKS + 1
    sums = blocks[:n].copy()
    for k in range(1, WINDOW_BLOCKS):
        sums += blocks[k: n + k]
    return sums


def group_maxima(project: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each word, the greatest product with a probe of each group of ``GROUP``."""
    return np.stack([(project @ q[k: k + GROUP].T).max(axis=1) for k in range(0, len(q), GROUP)], axis=1)


def similar(flat: np.ndarray, sizes: np.ndarray, project: np.ndarray, tops: np.ndarray, qt: np.ndarray, cosine_min: float):
    """(text, first word, probe, cosine) of all windows and probes of at least
    ``cosine_min``; texts are padded to a window at least.

    A window's product with a probe is the sum of its words' products, so the sum
    of their greatest products within a group of probes bounds it for the whole
    group.  Only windows whose bound allows the cosine are multiplied with a group's
    probes; no pair that has it is left out."""
    n_blocks = sizes // BLOCK
    text = np.repeat(np.arange(len(sizes)), n_blocks)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    sums = _window_sums(project_blocks(flat, project))
    bound = _window_sums(project_blocks(flat, tops))
    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", sums, sums)), 1e-6)
    norm[(first + WINDOW_BLOCKS > n_blocks[text])[: len(sums)]] = np.inf    # would reach into the next text
    sums /= norm[:, None]
    may = np.ascontiguousarray((bound >= (cosine_min - 1e-4) * norm[:, None]).T)   # a margin for rounding
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for g in range(len(may)):
        at = np.flatnonzero(may[g])
        if len(at):
            cos = sums[at] @ qt[:, g * GROUP: (g + 1) * GROUP]
            w, p = np.nonzero(cos >= cosine_min)
            found.append((at[w], p + g * GROUP, cos[w, p]))
    w, p, cos = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, w))
    w, p, cos = w[order], p[order], cos[order]
    return text[w], first[w] * BLOCK, p, cos


def _padded(rows: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([max(WINDOW_BLOCKS, -(-len(r) // BLOCK)) * BLOCK for r in rows], np.int64)
    out = np.full(int(sizes.sum()), none, np.int32)
    for r, a in zip(rows, np.cumsum(sizes) - sizes):
        out[a: a + len(r)] = r
    return out, sizes


#: The most frequent words, whose pairs a task adds up in place in half a matrix of at
#: most 67 MB; the pairs with others, of any number, are sorted.
DENSE_WORDS = 4096
#: Passages that are dealt by their known words at a time, those of them whose pairs
#: are made at a time (so few that what is made stays in the processor's cache), and
#: pairs that are sorted at a time.
_PASSAGES, _TOGETHER, _PAIRS = 1024, 128, 1_000_000


def passages(rows: list[np.ndarray], none: int, width: int = BLOCK * WINDOW_BLOCKS) -> np.ndarray:
    """Disjoint passages as long as a window, one in each row, padded with ``none``."""
    counts = [-(-len(r) // width) for r in rows]
    out = np.full((sum(counts), width), none, np.int32)
    flat, at = out.reshape(-1), 0
    for r, c in zip(rows, counts):
        flat[at * width: at * width + len(r)] = r
        at += c
    return out


def passage_products(words: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``passage_pairs`` as (first word * vocabulary + second word, product)."""
    for p, q, value in passage_pairs(words, idf):
        yield p * len(idf) + q, value


def passage_pairs(words: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, second word, first word <= second, and product) of the entries of A'A for the
    TF-IDF rows A, each of length one, of these passages; what a diagonal entry
    has from two places of a passage comes once with half its value.

    The order of a passage's words is of no account: they are sorted, so that
    unknown ones come last, and passages of equally many known words go together."""
    n = len(idf)
    for k in range(0, len(words), _PASSAGES):
        rows = np.sort(words[k: k + _PASSAGES], axis=1)
        known = (rows < n).sum(axis=1)
        for m in np.unique(known[known > 0]).tolist():
            x = rows[known == m, :m].astype(np.int64)
            weight = idf[x]
            square = (weight * weight).sum(axis=1)
            for d in range(1, m):                               # a word's places add up before they are squared
                same = x[:, d:] == x[:, :-d]
                if not same.any():
                    break
                square += 2 * np.where(same, weight[:, d:] * weight[:, :-d], 0).sum(axis=1)
            weight /= np.maximum(np.sqrt(square), 1e-6)[:, None]
            yield x.ravel(), x.ravel(), (weight * weight).ravel() / 2
            i, j = np.triu_indices(m, 1)
            for a in range(0, len(x) if len(i) else 0, _TOGETHER):
                some, w = x[a: a + _TOGETHER], weight[a: a + _TOGETHER]
                yield some.take(i, axis=1).ravel(), some.take(j, axis=1).ravel(), (w.take(i, axis=1) * w.take(j, axis=1)).ravel()


def word_products(numbers: DataFrame, idf: np.ndarray) -> tuple[DataFrame, int]:
    """The entries (row, col, v) of A'A over all passages of all documents, and how
    many passages there are.  Each task adds up its own; one exchange adds those up."""
    n = len(idf)
    order = np.arange(n) if n <= DENSE_WORDS else np.argsort(idf, kind="stable")   # the most frequent words first
    place = np.append(np.empty(n, np.int32), n).astype(np.int32)
    place[order] = np.arange(n)
    ordered, m = idf[order], min(n, DENSE_WORDS)
    diagonal = np.cumsum(np.r_[0, np.arange(m, 0, -1)])[:m]      # the rows of half a matrix, one after the other
    start = diagonal - np.arange(m)

    def coded(p, q):
        """Codes of the pairs of these places, by the words' numbers."""
        a, b = order[p], order[q]
        return np.minimum(a, b) * n + np.maximum(a, b)

    def add(batches):
        dense = np.zeros(m * (m + 1) // 2)                      # pairs p <= q < m at start[p] + q
        codes, values, count = np.zeros(0, np.int64), np.zeros(0), 0
        parts, held = [], 0

        def merged():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([v for _, v in parts]), minlength=len(codes))

        for b in batches:
            rows = place[passages([np.frombuffer(x, "<i4") for x in b.column(0).to_pylist()], n)]
            count += len(rows)
            for p, q, value in passage_pairs(rows, ordered):
                if m < n and len(rare := np.flatnonzero(q >= m)):
                    parts.append((coded(p[rare], q[rare]), value[rare]))
                    held += len(rare)
                    few = np.flatnonzero(q < m)
                    p, q, value = p[few], q[few], value[few]
                np.add.at(dense, start[p] + q, value)
                if held > _PAIRS:
                    codes, values = merged()
                    parts, held = [(codes, values)], 0
                    if len(codes) > _PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(values)], names=["code", "v"])
                        parts, codes, values = [], codes[:0], values[:0]
        if parts:
            codes, values = merged()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([float(count)])], names=["code", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(values)], names=["code", "v"])
        for k in range(0, len(dense), _PAIRS):                  # a copy of some entries at a time
            at = np.flatnonzero(dense[k: k + _PAIRS]) + k
            p = np.searchsorted(diagonal, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(coded(p, at - start[p])), pa.array(dense[at])], names=["code", "v"])

    # few tasks: each sends one row for each pair of words that it met
    files = numbers.select("words")
    sums = materialize(files.coalesce(16).mapInArrow(add, "code long, v double").groupBy("code").agg(F.sum("v").alias("v")), "word-products")
    count = sums.filter("code < 0").first()
    i, j = F.floor(F.col("code") / n).cast("int"), F.pmod("code", F.lit(n)).cast("int")
    half = sums.filter("code >= 0").select(i.alias("row"), j.alias("col"), "v")
    both = half.unionByName(half.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"))
    return materialize(both.repartition(8, "row").sortWithinPartitions("row"), "word-rows"), int(count["v"] or 0)


def latent_space(products: DataFrame, n_passages: int, items: Items, idf: np.ndarray, rank: int, passes: int = 2, weight: float = 5.0) -> np.ndarray:
    """Right singular vectors (word, dimension) of the TF-IDF passages of the
    benchmark and the documents; the benchmark's have ``weight`` times the energy."""
    n_words, width = len(idf), min(rank + 8, len(idf))
    probes = passages([np.array(p, np.int32) for _, _, p in items.probes()], n_words)
    scale = weight * max(n_passages, 1) / len(probes)
    parts = [*passage_products(probes, idf)]
    own, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    entries = np.bincount(at, np.concatenate([v for _, v in parts])) * scale
    own = np.concatenate([own, own % n_words * n_words + own // n_words])
    own, entries = own // n_words, np.stack([own % n_words, np.concatenate([entries, entries])], axis=1)
    order = np.argsort(own, kind="stable")
    own, own_col, own_v = own[order], entries[order, 0].astype(np.int64), entries[order, 1]

    def times(row, col, v, q):
        """(rows, their sums of v times q's row of col), for sorted rows a block at a time."""
        names, at = np.unique(row, return_index=True)
        at = np.append(at, len(row))
        for k in range(0, len(names), 128):
            a, z = at[k], at[min(k + 128, len(names))]
            block = np.zeros((min(128, len(names) - k), n_words), np.float32)
            np.add.at(block, (np.searchsorted(names[k: k + 128], row[a:z]), col[a:z]), v[a:z])
            yield names[k: k + 128], block @ q

    def total(q: np.ndarray) -> np.ndarray:
        shared = products.sparkSession.sparkContext.broadcast(q)

        def part(batches):
            for b in batches:
                row, col, v = (b.column(k).to_numpy() for k in range(3))
                for names, sums in times(row, col, v, shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["row", "part"])

        out = np.zeros((n_words, width), np.float32)
        for r in products.mapInArrow(part, "row int, part binary").toLocalIterator():   # one row for each word, or few
            out[r["row"]] += np.frombuffer(r["part"], np.float32)
        shared.unpersist()
        for names, sums in times(own, own_col, own_v, q):
            out[names] += sums
        return out

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((n_words, width)))[0].astype(np.float32)
    for _ in range(passes):
        q = np.linalg.qr(total(q))[0]
    values, vectors = np.linalg.eigh((q.T @ total(q)).astype(np.float64))
    return q @ vectors[:, np.argsort(-values)[:rank]].astype(np.float32)


def _verify(words: np.ndarray, found: list[tuple[int, int, int, float]], items: Items, lcs_min: float, paraphrase_min: float):
    """The leaks among one text's candidates (item, probe's first word, window's
    first word, cosine): best (item, cosine, share, answer, from, to) by item."""
    best: dict[int, tuple] = {}
    done = set()
    for k, o, s, cos in found:
        item = items.words[k]
        slack = 4 + len(item) // 4
        a, z = max(0, s - o - slack), min(len(words), s - o + BLOCK + len(item) + slack)
        if (k, a) in done:
            continue
        done.add((k, a))
        region = words[a:z].tolist()
        need = paraphrase_min * len(item)
        if sum(map(items.sets[k].__contains__, region)) < need:               # bounds the common subsequence
            continue
        share = lcs(item, region) / len(item)
        if share < paraphrase_min:
            continue
        answer = items.answers[k]
        has = bool(answer) and lcs(answer, region) >= 0.8 * len(answer)
        if (share >= lcs_min or has) and (k not in best or share > best[k][1]):
            best[k] = (cos, share, has, a, z)
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int | None = None, cosine_min: float = 0.6,
               lcs_min: float = 0.8, paraphrase_min: float = 0.6, block_items: int = 1000) -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_found, word_from, word_to) per
    document row and item that it leaks.  ``benchmark``: (item_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(docs[f"`{id_col}`"].alias("__id"), docs[f"`{text_col}`"].alias("__text"))
    schema = T.StructType([T.StructField("__id", source.schema["__id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
                           T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_found", T.BooleanType()),
                           T.StructField("word_from", T.LongType()), T.StructField("word_to", T.LongType())])
    blocks = max(1, -(-benchmark.count() // block_items))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").orderBy("item_id", "text").collect()
        items = Items.of(rows)
        if items.ids:
            out = out.unionByName(_search(source, items, schema, rank, cosine_min, lcs_min, paraphrase_min))
        short = [(r["item_id"], ws) for r in rows if 0 < len(ws := words_of(r["text"] or "")) < MIN_WORDS]
        if short:
            out = out.unionByName(_contiguous(source, short, schema))
    return out.withColumnRenamed("__id", id_col)


def _contiguous(source: DataFrame, short: list[tuple[object, list[bytes]]], schema: T.StructType) -> DataFrame:
    """The first place of each of these items (at most a block) in each text."""
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(schema["item_id"].dataType)
    by_first: dict[bytes, list[int]] = {}
    for k, (_, ws) in enumerate(short):
        by_first.setdefault(ws[0], []).append(k)
    shared = source.sparkSession.sparkContext.broadcast((short, by_first))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, by_first = shared.value
        for b, i, _, texts in _texts(batches, 1):
            rows, items, a, z = [], [], [], []
            for t, text in enumerate(texts):
                words, seen = words_of(text or ""), set()
                for at, w in enumerate(words):
                    for k in by_first.get(w, ()):
                        ws = short[k][1]
                        if k not in seen and words[at: at + len(ws)] == ws:
                            seen.add(k)
                            rows.append(i + t)
                            items.append(short[k][0])
                            a.append(at)
                            z.append(at + len(ws))
            n = len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.nulls(n, pa.float64()), pa.array([1.0] * n, pa.float64()),
                                              pa.array([True] * n, pa.bool_()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=schema.names)

    return source.mapInArrow(match, schema)


def _word_groups(batches: Iterator[pa.RecordBatch]):
    """(batch, first row, word numbers of its texts) in groups of a bounded size, so
    that a group's sums stay in the processor's cache."""
    for b in batches:
        words = [np.frombuffer(x, "<i4") for x in b.column(1).to_pylist()]
        for i, j in row_groups(np.cumsum([0, *map(len, words)]), _CHUNK // 24):
            yield b, i, words[i:j]


def _numbered(source: DataFrame, vocabulary) -> DataFrame:
    """(__id, words): each text's words as vocabulary numbers, written once."""
    def number(batches):
        for b, i, j, texts in _texts(batches, 1):
            words = [x.astype("<i4").tobytes() for x in _numbers(texts, vocabulary.value)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words, pa.binary())], names=["__id", "words"])

    schema = T.StructType([T.StructField("__id", source.schema["__id"].dataType), T.StructField("words", T.BinaryType())])
    return materialize(source.mapInArrow(number, schema), "latent-words")


def _search(source, items, schema, rank, cosine_min, lcs_min, paraphrase_min) -> DataFrame:
    spark = source.sparkSession
    numbers = _numbered(source, spark.sparkContext.broadcast(items.vocabulary))
    df, n = document_frequencies(numbers, len(items.vocabulary))
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    products, n_passages = word_products(numbers, idf)
    probes = items.probes()
    space = latent_space(products, n_passages, items, idf, rank or min(512, max(64, len(probes) // 2)))
    project = np.vstack([space * idf[:, None], np.zeros((1, space.shape[1]))]).astype(np.float32)
    q = np.stack([project[p].sum(axis=0) for _, _, p in probes])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast((project, group_maxima(project, q), np.ascontiguousarray(q.T), np.array([(k, o) for k, o, _ in probes]), items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, tops, qt, origin, items = shared.value
        for b, i, words in _word_groups(batches):
            flat, sizes = _padded(words, len(items.vocabulary))
            ids, found = [], []
            hits: dict[int, list] = {}
            text, first, probe, cos = similar(flat, sizes, project, tops, qt, cosine_min)
            for t, s, (k, o), c in zip(text.tolist(), first.tolist(), origin[probe].tolist(), cos.tolist()):
                hits.setdefault(t, []).append((k, o, s, c))
            for t in sorted(hits):
                for k, v in _verify(words[t], hits[t], items, lcs_min, paraphrase_min).items():
                    ids.append(i + t)
                    found.append((items.ids[k], *v))
            cols = list(zip(*found)) or [()] * 6
            kinds = [pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(cols[0], ITEM_TYPE), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))],
                                             names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    ITEM_TYPE = to_arrow_type(schema["item_id"].dataType)
    return numbers.mapInArrow(search, schema)
