"""Operator 11: MinHash near-duplicates through a multi-index Hamming join.

A document's set is its distinct word shingles, as 64-bit hashes.  Equal sets are
one class first.  A class has a b-bit signature: the low 16 bits of 70 minima,
cut into 14 chunks of 5 symbols.  Of two signatures that differ in at most 27
symbols, some chunk differs in at most one (pigeonhole: 14 chunks with two errors
each are 28), so that chunk is equal with one symbol left out.  Enumerating the
allowed error gives 5 keys a chunk and 70 a class, and every pair under the
distance shares one of them.  Two sets of Jaccard similarity 0.85 differ in more
than 27 symbols with a probability of 3.5e-7; closer ones less often.

Classes under one key are not paired with each other.  They are first compared
with the smallest of their key, only the nearest such partner is confirmed on the
full sets, and confirmed links make components; that joins a group of copies in
one linear pass.  What is left are the keys whose classes lie in several
components.  Their classes, with their full sets, are put into blocks of bounded
size (those that meet at one smallest class together, a main component's apart
from the others); blocks that share such a key meet in pairs, blocks of one and
the same component don't.  A pair of blocks takes all pairs of classes of
different components within the distance, confirms them by products of 0/1
matrices over the shared hashes, and emits a spanning forest of the links.  So
every link within the distance either is confirmed or lies inside a component
already, and nothing that is emitted grows with the square of a group.

Confirming recomputes full sets from the texts of the classes concerned only.

Defined results: null, empty and blank texts have an empty set, are linked with
nothing and are their own component; a null id keeps its row, with a component
from the others' ids (null without any) and ``kept`` false; repeated rows stay,
each kept if its id is the component's; extra columns stay, unless they have a
name of the result's; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, join_counted, materialize, mix64, row_groups, utf8_buffer
from codeloom.llm.components import components, local_roots

CHUNKS, WIDTH = 14, 5
SYMBOLS = CHUNKS * WIDTH
#: Differing symbols up to which no pair is missed.
DISTANCE = 2 * CHUNKS - 1
#: Classes, and hashes of their sets (1 MB), in one block.
BLOCK, BLOCK_HASHES = 512, 1 << 17
#: Shared hashes that one matrix product covers.
SLAB = 1 << 14
_RNG = np.random.default_rng(11)
_XOR, _MUL = _RNG.integers(0, 2**64, SYMBOLS, np.uint64), _RNG.integers(0, 2**64, SYMBOLS, np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, (CHUNKS, WIDTH), np.uint64)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()                               # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(length)
    starts = (ends - length)[: len(words) - size + 1].tolist()
    stops = (ends - 1)[size - 1:].tolist()
    return np.unique(np.array([xxh64_intdigest(line[a:b]) for a, b in zip(starts, stops)], np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols for each set (none empty)."""
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), "<u2")
    for k in range(SYMBOLS):
        out[:, k] = np.minimum.reduceat((every ^ _XOR[k]) * _MUL[k], starts) & np.uint64(0xFFFF)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Rows of signatures to rows of keys: each chunk without each symbol."""
    parts = sig.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
    for j in range(WIDTH):
        key = np.zeros((len(sig), CHUNKS), np.uint64)
        for i in range(WIDTH):
            if i != j:
                key = (key << np.uint64(16)) | parts[:, :, i]
        out[:, :, j] = mix64(key ^ _PLACE[:, j])
    return out.reshape(len(sig), -1)


def _texts(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, first row, sets) of bounded pieces; the text is the last column."""
    for b in batches:
        data, offs = utf8_buffer(b.column(b.num_columns - 1))
        for i, j in row_groups(offs):
            raw, o = data[offs[i]: offs[j]].tobytes(), (offs[i: j + 1] - offs[i]).tolist()
            yield b, i, [shingles(raw[x:y], size) for x, y in zip(o, o[1:])]


def _set_digests(sets: list[np.ndarray]) -> np.ndarray:
    from xxhash import xxh128_digest

    return np.frombuffer(b"".join(xxh128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)


def _digested(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(row, id, n, da, db, sig): all columns but the text, set size, digest of
    the set, signature."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, sets in _texts(batches, size):
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full) if full else ())
            d = _set_digests(sets)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), b.column(1).slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()),
                                              pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], names=["row", "id", "n", "da", "db", "sig"])

    schema = T.StructType([*src.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("n", "da", "db")), T.StructField("sig", T.BinaryType())])
    return src.mapInArrow(run, schema)


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = chunk_keys(_sigs(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), SYMBOLS))], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _sigs(col: pa.Array) -> np.ndarray:
    data, _ = utf8_buffer(col)
    return data.view("<u2").reshape(-1, SYMBOLS) if data.ctypes.data % 2 == 0 else data.copy().view("<u2").reshape(-1, SYMBOLS)


def _within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(u, v, apart): pairs whose signatures and set sizes allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = (_sigs(b.column(2)) != _sigs(b.column(3))).sum(axis=1)
            near = np.flatnonzero(apart <= DISTANCE)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(near)), b.column(1).take(pa.array(near)), pa.array(apart[near].astype(np.int32))], names=["u", "v", "apart"])

    def side(x):
        return classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    met = pairs.join(side("u"), "u").join(side("v"), "v").filter((F.col("n_u") * 100 >= F.col("n_v") * percent) & (F.col("n_v") * 100 >= F.col("n_u") * percent))
    return met.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long, apart int")


def _full_sets(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, hashes) of these classes (node, first, da, db), from their texts."""
    wanted = materialize(classes.select("node", "first", "da", "db"), "minhash-wanted")
    ids = wanted.select(F.col("first").alias("id")).distinct()
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    some = join_counted(src.filter("id is not null"), materialize(ids.filter("id is not null"), "minhash-ids"), ["id"], "left_semi").select("text")
    if not ids.filter("id is null").isEmpty():                 # classes of which no row has an id
        some = some.unionByName(src.filter("id is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _texts(batches, size):
            d = _set_digests(sets)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["da", "db", "hashes"])

    found = some.mapInArrow(run, "da long, db long, hashes binary")
    return materialize(join_counted(found, wanted.select("node", "da", "db"), ["da", "db"], "inner").select("node", "hashes").dropDuplicates(["node"]), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (u, v) whose full sets are similar enough."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_buffer(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(np.flatnonzero(good), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    def side(x):
        return sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}"))
    bounded_batches(pairs.sparkSession, 200)                   # pairs of whole sets
    out = materialize(pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v").mapInArrow(check, "a long, b long"), "minhash-links")
    bounded_batches(pairs.sparkSession)
    return out


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every class, written."""
    return materialize(classes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "minhash-components")


def _mixed(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, root, pivot) of the keys whose classes lie in several components."""
    rows = materialize(hits.join(labels, "node"), "minhash-rows")
    keys = materialize(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"), "minhash-mixed")
    return materialize(rows.join(keys, "key"), "minhash-left")


def _block_links(left: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): a spanning forest of the links between components among classes that share a key."""
    nodes = left.groupBy("node").agg(F.min("root").alias("root"), F.min("pivot").alias("anchor"))
    nodes = materialize(nodes.join(classes.select("node", "n"), "node"), "minhash-nodes")
    anchors = materialize(nodes.groupBy("anchor").agg(F.min("root").alias("main"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("parts")), "minhash-anchors")
    dealt = join_counted(nodes, anchors, ["anchor"]).withColumns({"minor": F.col("root") != F.col("main"), "part": F.pmod(F.xxhash64("node"), F.col("parts"))})
    dealt = dealt.join(classes.select("node", "sig"), "node").join(sets, "node")
    blocks = materialize(dealt.groupBy("anchor", "minor", "part").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.collect_list(F.struct("node", "root", "n", "sig", "hashes")).alias("members")).withColumn("block", F.monotonically_increasing_id()), "minhash-blocks")
    at = blocks.select("block", F.explode("members.node").alias("node"))
    keyed = materialize(left.select("key", "node").join(at, "node").select("key", "block").distinct(), "minhash-keyed")
    ends = blocks.select("block", "lo", "hi")
    pairs = keyed.withColumnRenamed("block", "x").join(keyed.withColumnRenamed("block", "y"), "key").filter("x <= y").select("x", "y").distinct()
    pairs = (pairs.join(ends.toDF("x", "lo_x", "hi_x"), "x").join(ends.toDF("y", "lo_y", "hi_y"), "y")
             .filter(~((F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y")))).select("x", "y"))
    data = blocks.select("block", "members")
    met = (materialize(pairs, "minhash-block-pairs").join(data.toDF("x", "mx"), "x").join(data.toDF("y", "my"), "y").select("x", "y", "mx", "my"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                same = b.column(0)[r].as_py() == b.column(1)[r].as_py()
                x, y = (_Members(b.column(c)[r].values) for c in (2, 3))
                u, v = linked(x, y, same, percent)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["a", "b"])

    bounded_batches(left.sparkSession, 4)                      # pairs of blocks, some 2 MB each
    out = materialize(met.mapInArrow(run, "a long, b long"), "minhash-block-links")
    bounded_batches(left.sparkSession)
    return out


class _Members:
    """A block's classes as arrays."""

    def __init__(self, s: pa.StructArray):
        self.node, self.root, self.n = (s.field(c).to_numpy() for c in ("node", "root", "n"))
        self.sig = _sigs(s.field("sig"))
        data, offs = utf8_buffer(s.field("hashes"))
        self.hashes, self.offs = np.frombuffer(data.tobytes(), "<u8"), offs // 8

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of these rows, and the place in ``rows`` of each."""
        n = self.n[rows]
        return np.concatenate([self.hashes[self.offs[r]: self.offs[r + 1]] for r in rows]), np.repeat(np.arange(len(rows)), n)


def shared_hashes(x: _Members, y: _Members, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``rows`` of x with ``cols`` of y."""
    (hx, ix), (hy, iy) = x.of(rows), y.of(cols)
    common = np.intersect1d(hx, hy)
    out = np.zeros((len(rows), len(cols)), np.float32)
    for k in range(0, len(common), SLAB):
        slab = common[k: k + SLAB]

        def ones(h, i, n):
            at = np.minimum(np.searchsorted(slab, h), len(slab) - 1)
            hit = slab[at] == h
            m = np.zeros((n, len(slab)), np.float32)
            m[i[hit], at[hit]] = 1
            return m
        out += ones(hx, ix, len(rows)) @ ones(hy, iy, len(cols)).T
    return out.astype(np.int64)


def linked(x: _Members, y: _Members, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between different components of two blocks."""
    p, q = [], []
    for i in range(0, len(x.node), 64):
        a = slice(i, i + 64)
        near = (x.sig[a, None, :] != y.sig[None, :, :]).sum(axis=2) <= DISTANCE
        near &= (x.root[a, None] != y.root[None, :]) & (100 * np.minimum(x.n[a, None], y.n[None, :]) >= percent * np.maximum(x.n[a, None], y.n[None, :]))
        if same:
            near &= x.node[a, None] < y.node[None, :]
        u, v = np.nonzero(near)
        p.append(u + i)
        q.append(v)
    p, q = np.concatenate(p), np.concatenate(q)
    if not len(p):
        return p, q
    (rows, ip), (cols, iq) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    both = shared_hashes(x, y, rows, cols)[ip, iq]
    good = 100 * both >= percent * (x.n[p] + y.n[q] - both)
    names, ends = np.unique(np.concatenate([x.node[p[good]], y.node[q[good]]]), return_inverse=True)
    root = local_roots(len(names), *np.split(ends, 2))
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """Columns of ``docs`` without the text, n_shingles, component_id (smallest id
    that links of at least ``percent`` / 100 reach, itself included) and kept."""
    rows = materialize(_digested(docs, id_col, text_col, shingle), "minhash-documents")
    classes = materialize(rows.filter("n > 0").groupBy("da", "db").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
                          .withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    keys = materialize(_keys(classes), "minhash-keys")
    shared = materialize(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot"), "minhash-shared")
    hits = materialize(join_counted(keys, shared, ["key"], "inner"), "minhash-hits")

    first = hits.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    nearest = materialize(_within(first, classes, percent).groupBy("v").agg(F.min(F.struct("apart", "u")).alias("m")).select("m.u", "v"), "minhash-nearest")
    concerned = materialize(nearest.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "minhash-concerned")
    links = _confirmed(nearest, _full_sets(classes.join(concerned, "node"), docs, id_col, text_col, shingle), percent)
    left = _mixed(hits, _labelled(classes, links))
    concerned = materialize(left.select("node").distinct(), "minhash-concerned")
    more = _block_links(left, classes, _full_sets(classes.join(concerned, "node"), docs, id_col, text_col, shingle), percent, block)
    labels = _labelled(classes, links.unionByName(more))

    named = materialize(classes.join(labels, "node").select("da", "db", "first", "root"), "minhash-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(named.join(least, "root").select("da", "db", "component_id"), "minhash-found")
    out = rows.select("row", "id", F.col("n").alias("n_shingles"), "da", "db").join(found, ["da", "db"], "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")))
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("n_shingles", "component_id", "kept")]
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive worded as (select doc_id, regexp_extract_all(translate(coalesce("text", ''), '{upper}', '{lower}'), '[^ \\t\\n\\x0B\\f\\r]+') as w from documents),
cut as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from worded),
classes as (select min(doc_id) as node, list_sort(s) as s, len(s) as n from cut where len(s) > 0 group by 2, 3),
shingles as (select node, n, unnest(s) as g from classes),
links as (select a.node as u, b.node as v from shingles a join shingles b on a.g = b.g and a.node < b.node and a.n * 100 >= b.n * 85 and b.n * 100 >= a.n * 85
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges as (select u, v from links union all select v, u from links),
reach as (select node, node as r from classes union select reach.node, edges.v from reach join edges on reach.r = edges.u),
least as (select node, min(r) as component_id from reach group by 1),
of_sets as (select s, component_id from classes join least using (node))
select doc_id, len(cut.s) as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from cut left join of_sets on of_sets.s = list_sort(cut.s)"""
