"""Operator 1: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints (64 bits, majority over the XXH64 values of all word shingles,
repeats included) are first grouped: a group of copies is one class.  Distinct
fingerprints are indexed once for each of ``max_bits`` + 1 ranges of bits, rotated
so that the range leads: of those ranges two fingerprints within ``max_bits`` bits
agree fully in one, so each index only has to join what shares its leading range.

An index is range-partitioned and sorted by Gray rank (the position in reflected
Gray order, where neighbours share long bit patterns; its leading bits number the
leading range) and cut into blocks: of whole groups of an equal range, or, where
a group is larger than a block or lies at a partition's end, of one group.  A block
keeps the bits that all its members share (``ones`` set, ``zeros`` unset in all);
nodes above factor out what their blocks share, level by level, by prefix of the
Gray rank.  Blocks of whole groups are joined with themselves.  The blocks of one
group are joined down this tree from the pair (group, group): shared differing bits
accumulate, and a pair of nodes is dropped with all below it as soon as they exceed
the limit.  Surviving pairs of blocks meet in one task, which goes on in the same
way with leaves of 64 fingerprints, compares what is left bit by bit, and emits a
spanning forest instead of all pairs.  So no link is lost, pairs of blocks grow with
the blocks and not with their square, and a dense group of n fingerprints
gives n links per task, not n squared.

Defined results: null, empty or blank texts have fingerprint zero, linked like
any other; null ids keep their row, and a component without any id has a null
component_id; repeated rows stay in the result of ``near_duplicates``;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, materialize, row_groups, unique_name, utf8_buffer
from codeloom.llm.components import components, local_roots

LEAF, FAN_BITS = 64, 5
#: Pairs of leaves that are compared at a time, and links held before they are
#: reduced to a forest: a dense group links nearly all that is compared.
LEAF_PAIRS, HELD_LINKS = 32, 1 << 17
#: Fingerprints in a block: 64 KB, the unit that tasks exchange.
BLOCK = 8192
#: For each byte a 64-bit number whose byte k is bit k.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(h)
    if n == 0:
        return 0
    lanes = np.zeros((-(-n // 255) * 255, 8), "<u8")           # 255 additions fit into a byte
    lanes[:n] = _SPREAD[h.astype("<u8").view(np.uint8).reshape(n, 8)]
    counts = lanes.reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def text_fingerprint(text: bytes, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()                               # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    return majority(np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, out_col: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    old = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() != out_col]
    keep = [f.name for f in old]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias(*unique_name(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = utf8_buffer(b.column(b.num_columns - 1))
            fp = []
            for i, j in row_groups(offs):
                raw, o = data[offs[i]: offs[j]].tobytes(), (offs[i: j + 1] - offs[i]).tolist()
                fp += [text_fingerprint(raw[x:y], shingle) for x, y in zip(o, o[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(fp, np.uint64).view(np.int64))], names=[*keep, out_col])

    return src.mapInArrow(run, T.StructType([*old, T.StructField(out_col, T.LongType())]))


def gray_rank(code):
    """Position in reflected Gray order, as a number whose signed order is it."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _rotated(code, by: int):
    return F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by)) if by else code


def _blocks(codes: DataFrame, n: int, size: int, ranges: int) -> DataFrame:
    """Blocks of Gray-ordered codes of every index (``turn``): first rank, the
    group if it is the only one (``part``), shared bits, codes."""
    width = 64 // ranges

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = np.zeros((0, 3), np.int64), False        # turn, rank, code; the first group has begun before

        def emit(x, part):
            c = x[:, 2].copy()
            top = int(x[0, 1] >> (64 - width))
            return pa.RecordBatch.from_arrays([pa.array(x[:1, 0]), pa.array(x[:1, 1]), pa.array([top if part else None], pa.int64()), pa.array([np.bitwise_and.reduce(c)], pa.int64()),
                                               pa.array([np.bitwise_and.reduce(~c)], pa.int64()), pa.array([c.astype("<i8").tobytes()], pa.binary())],
                                              names=["turn", "rank", "part", "ones", "zeros", "codes"])

        def pieces(x):
            return (emit(x[k: k + size], True) for k in range(0, len(x), size))

        first = True
        for b in batches:
            held = np.concatenate([held, np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)])
            if not len(held):
                continue
            top = held[:, 1] >> (64 - width)
            ends = (np.flatnonzero((top[1:] != top[:-1]) | (held[1:, 0] != held[:-1, 0])) + 1).tolist()
            a = start = 0                                      # of the open block, of the group
            for z in ends:
                alone = first or begun or z - start > size
                if alone or z - a > size or held[a, 0] != held[start, 0]:
                    if start > a:
                        yield emit(held[a:start], False)
                    a = start
                if alone:
                    yield from pieces(held[start:z])
                    a = z
                first = begun = False
                start = z
            if start > a:
                yield emit(held[a:start], False)
            held = held[start:]
            while len(held) > size:                            # a group larger than a block
                yield emit(held[:size], True)
                held, begun = held[size:], True
        if len(held):
            yield from pieces(held)

    turns = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), _rotated(F.col("fp"), k * width).alias("code")) for k in range(ranges)]))
    rows = codes.select(turns.alias("t")).select("t.turn", gray_rank(F.col("t.code")).alias("rank"), "t.code")
    return (rows.repartitionByRange(max(1, -(-n * ranges // (8 * size))), "turn", "rank").sortWithinPartitions("turn", "rank")
            .mapInArrow(cut, "turn long, rank long, part long, ones long, zeros long, codes binary").withColumn("block", F.monotonically_increasing_id()))


def _differ():
    """Bits that all members of node a and all of node b differ in."""
    return F.bit_count(F.col("a.ones").bitwiseAND(F.col("b.zeros")).bitwiseOR(F.col("a.zeros").bitwiseAND(F.col("b.ones"))))


def block_pairs(blocks: DataFrame, limit: int, ranges: int) -> DataFrame:
    """(x, y): each block with itself, and of the blocks of one group those pairs
    that the descent through the tree leaves."""
    width = 64 // ranges
    alone = blocks.select(F.col("block").alias("x"), F.col("block").alias("y"))
    parts = blocks.filter("part is not null").select("block", "turn", "ones", "zeros", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))
    most = parts.groupBy("turn", F.shiftrightunsigned("rank", 64 - width)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most < 2:
        return alone
    depth = width + FAN_BITS * max(1, -(-(most - 1).bit_length() // FAN_BITS))
    pairs = None
    for bits in [*range(width + FAN_BITS, depth + 1, FAN_BITS), None]:
        if bits is None or bits > 64:                          # last level: the blocks
            x = parts.select(F.col("block").alias("node"), "turn", F.shiftrightunsigned("rank", 64 - min(depth, 64)).alias("up"), "ones", "zeros")
        else:
            x = (parts.groupBy("turn", F.shiftrightunsigned("rank", 64 - bits).alias("node"), F.shiftrightunsigned("rank", 64 - bits + FAN_BITS).alias("up"))
                 .agg(F.expr("bit_and(ones)").alias("ones"), F.expr("bit_and(zeros)").alias("zeros")))
        a, b = x.alias("a"), x.alias("b")
        if pairs is None:                                      # the children of a group
            j = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.up") == F.col("b.up")))
        else:
            j = (pairs.alias("p").join(a, (F.col("p.turn") == F.col("a.turn")) & (F.col("p.x") == F.col("a.up")))
                 .join(b, (F.col("p.turn") == F.col("b.turn")) & (F.col("p.y") == F.col("b.up"))))
        once = (F.col("a.node") <= F.col("b.node")) | (F.col("a.up") < F.col("b.up"))
        pairs = j.filter(once).filter(_differ() <= limit).select("a.turn", F.col("a.node").alias("x"), F.col("b.node").alias("y"))
        if bits is None or bits > 64:
            break
    return alone.unionByName(pairs.filter("x <> y").select("x", "y"))


def near(a: np.ndarray, b: np.ndarray, limit: int, same: bool, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (codes of either end) of the pairs of a and b within
    ``limit`` bits that agree in their leading ``width`` bits; both are in Gray
    order, and two different blocks are of one group."""
    def leaves(x):
        pad = np.concatenate([x, np.full(-len(x) % LEAF, x[-1], np.uint64)]).reshape(-1, LEAF)
        return pad, np.bitwise_and.reduce(pad, axis=1), np.bitwise_and.reduce(~pad, axis=1)
    (pa_, oa, za), (pb, ob, zb) = leaves(a), leaves(b)
    apart = np.bitwise_count((oa[:, None] & zb) | (za[:, None] & ob))
    i, j = np.nonzero(apart <= limit)
    if same:
        i, j = i[i <= j], j[i <= j]
        top = pa_ >> np.uint64(64 - width) if width else np.zeros_like(pa_)
        share = (i == j) | (top[i, -1] == top[j, 0])           # a group goes on from leaf i to leaf j
        i, j = i[share], j[share]
    root = np.arange(len(a) if same else len(a) + len(b))
    us, vs, held = [], [], 0
    for k in range(0, len(i), LEAF_PAIRS):
        p, q = i[k: k + LEAF_PAIRS], j[k: k + LEAF_PAIRS]
        c, x, y = np.nonzero(np.bitwise_count(pa_[p][:, :, None] ^ pb[q][:, None, :]) <= limit)
        u, v = p[c] * LEAF + x, q[c] * LEAF + y
        ok = (u < len(a)) & (v < len(b)) & ((u < v) if same else True)
        us.append(u[ok])
        vs.append(v[ok] + (0 if same else len(a)))
        held += len(us[-1])
        if held > HELD_LINKS:                                  # keep a forest only
            r = local_roots(len(root), np.concatenate([*us, np.arange(len(root))]), np.concatenate([*vs, root]))
            root, us, vs, held = r, [], [], 0
    if us:
        root = local_roots(len(root), np.concatenate([*us, np.arange(len(root))]), np.concatenate([*vs, root]))
    every = a if same else np.concatenate([a, b])
    child = np.flatnonzero(root != np.arange(len(root)))
    return every[child], every[root[child]]


def links(codes: DataFrame, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp`` of ``codes``)
    with the same components as all links of at most ``max_bits`` bits."""
    ranges = max_bits + 1
    width = 64 // ranges
    blocks = materialize(_blocks(codes, codes.count(), block, ranges), "gray-blocks")
    pairs = materialize(block_pairs(blocks, max_bits, ranges), "gray-pairs")
    data = blocks.select("block", "turn", "codes")
    met = (pairs.join(data.toDF("x", "turn", "ca"), "x").join(data.drop("turn").toDF("y", "cb"), "y").select("x", "y", "ca", "cb", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[r].as_py(), "<i8").view(np.uint64) for c in (2, 3))
                back = np.uint64(b.column(4)[r].as_py() * width)
                out = near(x, y, max_bits, b.column(0)[r].as_py() == b.column(1)[r].as_py(), width)
                u, v = (((c >> back) | (c << (np.uint64(64) - back)) if back else c).view(np.int64) for c in out)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    bounded_batches(codes.sparkSession, 64)                    # pairs of blocks, 128 KB each
    out = materialize(met.mapInArrow(run, "a long, b long"), "simhash-links")
    bounded_batches(codes.sparkSession)
    return out


def components_of(fps: DataFrame, id_col: str = "doc_id", max_bits: int = 3) -> DataFrame:
    """(fp, component_id, n): each distinct fingerprint's component and class size."""
    classes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "simhash-classes")
    root = components(links(classes.select("fp"), max_bits))
    named = materialize(classes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    return materialize(named.join(least, "root").select("fp", "component_id", "n", "root"), "simhash-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Columns of ``docs`` without the text, fingerprint (16 hexadecimal digits),
    component_id (the smallest id that is reachable)."""
    fps = materialize(fingerprints(docs, text_col, shingle), "simhash")
    keep = [c for c in fps.columns if c.lower() not in ("fp", "fingerprint", "component_id")]
    found = components_of(fps, id_col, max_bits).select("fp", "component_id")
    return fps.join(found, "fp").select(*[F.col(f"`{c}`") for c in keep], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id
    (rows without one last), of rows with equal id and text one."""
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256)
    fps = materialize(fingerprints(docs.select(key.alias("__key"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")), "__text", shingle), "simhash")
    found = components_of(fps.withColumnRenamed("__id", "id"), "id", max_bits).select("fp", "root")
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__key"))
    stays = materialize(fps.join(found, "fp").groupBy("root").agg(first.alias("m")).select("m.__key"), "simhash-stays")
    own, = unique_name(docs, "key")
    return docs.withColumn(own, key).join(stays.toDF(own), own, "left_semi").dropDuplicates([own]).drop(own)
