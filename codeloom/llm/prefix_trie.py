"""Operator 13: conversation prefix trie by whole-sequence collapse.

Turns are read once and reduced to two 64-bit hashes and a length; no text is
shuffled unless two turns of one conversation tie.  ``place`` gives each turn its
position from a range-partitioned sort, so that a conversation of any length is
spread over tasks.  ``rebuild`` puts the first turns of another conversation in
front.  Then whole conversations collapse: a sequence is known by its length and
the exclusive or of its turns' hashes, each mixed with its position (128 bits),
so identical conversations meet by a plain grouped aggregation and become one
weighted sequence with its list of members.  Only one conversation of each
distinct sequence goes on.  Its prefixes get the same hashes by a running
exclusive or; sequences that are proper prefixes of others are found by an
anti-join, the others are the leaves.  Every number of a node is a grouped
aggregate over the weighted prefixes:

* a node's owner is its smallest leaf, so the nodes that a leaf owns are the
  lower end of its path, and what a subtree saves is the sum over its leaves of
  what they own, less what the node's own owner holds above the node.

Running values are taken in chunks of positions with carried totals, hot nodes
(the root, a first turn that many share) only meet in aggregates that combine
before their shuffle or in plain joins of written tables, and the digest of a
member list streams over pieces of 4,096 ids.

Defined results: turns of equal number go by role, then text; repeated rows are
turns of their own; a null role or text is empty; rows with a null conversation
id belong to no conversation; other columns are ignored; an empty table gives no
nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import join_counted, materialize
from codeloom.llm.oracle_parts import CRC_TABLE, crc32

#: Positions that one window task holds at most; member ids in one piece.
CHUNK, PIECE = 4096, 4096
NODE = ["depth", "ha", "hb"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def place(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, a, b, chars): position from 0, two hashes and code points of
    each turn, ordered by turn (null first), role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(f"`{turn_col}`")
    keyed = convs.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("conv"), turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("at"), role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), F.length(text).cast("long").alias("chars"))
    both = F.struct("a", "b")
    ties = materialize(keyed.groupBy("conv", "has", "at").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).filter("lo <> hi").select("conv", "has", "at", F.lit(True).alias("tied")), "trie-ties")
    rows = join_counted(keyed, ties, ["conv", "has", "at"])
    rows = rows.select("conv", "has", "at", F.when(F.col("tied"), F.col("role")).alias("role"), F.when(F.col("tied"), F.col("text")).alias("text"), "a", "b", "chars")
    order = ["conv", "has", "at", "role", "text", "a", "b"]
    dealt = rows.repartitionByRange(_partitions(convs), *order).sortWithinPartitions(*order).select("conv", "a", "b", "chars", F.spark_partition_id().alias("part"))
    placed = materialize(dealt.mapInArrow(_number, "conv long, a long, b long, chars long, part int, pos long"), "trie-placed")
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    split = parts.groupBy("conv").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = materialize(parts.join(split, "conv").select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved")), "trie-offsets")
    return join_counted(placed, moved, ["conv", "part"]).select("conv", (F.col("pos") + F.coalesce("moved", F.lit(0))).alias("pos"), "a", "b", "chars")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``conv``: their number within it, as far as this task goes."""
    last, seen = None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        if not len(conv):
            continue
        at = np.arange(len(conv))
        new = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, at, -1))
        pos = np.where(start < 0, seen + at, at - start)
        last, seen = conv[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], names=["conv", "a", "b", "chars", "part", "pos"])


def rebuild(placed: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversation c starts with the first h turns of conversation c - c % group
    and goes on with its own turns after its first h; h is crc32 of its decimal
    id modulo ``most``.  Returns (turns as from ``place``, all conversations)."""
    conv = F.col("conv")
    h, base = F.crc32(conv.cast("string").cast("binary")) % most, conv - conv % group
    heads = materialize(placed.filter((conv % group == 0) & (F.col("pos") < most - 1)).groupBy(conv.alias("base"))
                        .agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("head")), "trie-heads")
    convs = materialize(placed.select("conv").distinct(), "trie-conversations")
    had = F.coalesce(F.size("head"), F.lit(0))                 # turns of the base, as far as they count
    own = (placed.filter(F.col("pos") >= h).withColumn("base", base).join(heads.select("base", had.alias("had")), "base", "left")
           .select("conv", (F.col("pos") - h + F.least(h, F.coalesce("had", F.lit(0)))).alias("pos"), "a", "b", "chars"))
    taken = (convs.select("conv", base.alias("base"), h.cast("int").alias("h")).filter("h > 0").join(heads, "base")
             .select("conv", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("t")).select("conv", "t.pos", "t.a", "t.b", "t.chars"))
    return materialize(own.unionByName(taken), "trie-rebuilt"), convs


def running(df: DataFrame, key: str, pos: str, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running aggregates, up to and including each row: ``values`` maps a
    new column to ("sum" or "bit_xor", value).  A key's positions are cut into
    chunks, so no task holds more than one of them; the chunks' totals carry on."""
    cut = df.withColumns({"chunk": F.floor(F.col(pos) / CHUNK)} | {k: v for k, (_, v) in values.items()})
    here = Window.partitionBy(key, "chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long_ones = cut.filter("chunk > 0").select(key).distinct()
    totals = cut.join(long_ones, key, "left_semi").groupBy(key, "chunk").agg(*[F.expr(f"{f}({k})").alias(k) for k, (f, _) in values.items()])
    carried = materialize(totals.select(key, "chunk", *[F.expr(f"{f}({k})").over(past).alias(f"{k}_past") for k, (f, _) in values.items()]), "trie-carried")
    out = join_counted(cut.withColumns({k: F.expr(f"{f}({k})").over(here) for k, (f, _) in values.items()}), carried, [key, "chunk"])
    for k, (f, _) in values.items():
        past_value = F.coalesce(f"{k}_past", F.lit(0))
        out = out.withColumn(k, F.col(k) + past_value if f == "sum" else F.col(k).bitwiseXOR(past_value))
    return out.select(*df.columns, *values)


def _digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids ``conv`` of each sequence."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            ids = b.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]).any(axis=1)) + 1).tolist(), len(ids)] if ids else [0]
            rows = [(i, min(i + PIECE, y)) for x, y in zip(cuts, cuts[1:]) for i in range(x, y, PIECE)]
            first = [i for i, _ in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(node[first, k]) for k in range(3)), pa.array([ids[i] for i in first], pa.int64()),
                                              pa.array([",".join(map(str, ids[i:j])) for i, j in rows], pa.string())], names=[*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None

        def out(done):
            return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x, _ in done], pa.int64()) for k in range(3)), pa.array([s for _, s in done], pa.string())], names=[*NODE, "ends_sha256"])
        for b in batches:
            done = []
            for *node, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if node == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((last, sha.hexdigest()))
                last, sha = node, hashlib.sha256(ids.encode())
            yield out(done)
        if last is not None:
            yield out([(last, sha.hexdigest())])

    n = _partitions(members)
    sorted_ids = members.select(*NODE, "conv").repartitionByRange(n, *NODE, "conv").sortWithinPartitions(*NODE, "conv")
    pieces = materialize(sorted_ids.mapInArrow(join, "depth long, ha long, hb long, first long, ids string"), "trie-members")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, ha long, hb long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences ``turns`` (conv, pos, a,
    b, chars); ``convs`` (conv) lists all of them, those without turns too."""
    mixed = [F.xxhash64(c, "pos") for c in ("a", "b")]
    whole = turns.groupBy("conv").agg(F.count("*").alias("depth"), F.bit_xor(mixed[0]).alias("ha"), F.bit_xor(mixed[1]).alias("hb"))
    ends = materialize(convs.join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in NODE]), "trie-ends")
    seqs = materialize(ends.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("rep")), "trie-sequences")

    # one conversation of each sequence: all its prefixes, the root among them
    one = turns.join(seqs.select(F.col("rep").alias("conv"), "weight", F.col("depth").alias("len")), "conv")
    ran = running(one, "conv", "pos", {"ha": ("bit_xor", mixed[0]), "hb": ("bit_xor", mixed[1])})
    below = ran.select(F.col("conv").alias("rep"), "weight", "len", (F.col("pos") + 1).alias("depth"), "ha", "hb",
                       F.col("ha").bitwiseXOR(mixed[0]).alias("up_a"), F.col("hb").bitwiseXOR(mixed[1]).alias("up_b"), "chars")
    zero = F.lit(0).cast("long")
    root = seqs.select("rep", "weight", F.col("depth").alias("len"), *[zero.alias(c) for c in (*NODE, "up_a", "up_b", "chars")])
    prefixes = materialize(below.unionByName(root), "trie-prefixes")
    inner = prefixes.filter("depth < len").select(*NODE).distinct()
    leaves = materialize(seqs.join(inner, NODE, "left_anti").select("rep", F.lit(1).alias("leaf")), "trie-leaves")
    paths = materialize(prefixes.join(leaves, "rep", "left"), "trie-paths")

    nodes = materialize(paths.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("rep"))).alias("owner"),
        F.max("chars").alias("chars")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-nodes")
    owned = nodes.groupBy(F.col("owner").alias("rep")).agg(F.sum("saved").alias("owned"))
    of_leaves = paths.filter("leaf = 1").select("rep", *NODE).join(owned, "rep").groupBy(*NODE).agg(F.sum("owned").alias("of_leaves"))
    above = running(nodes, "owner", "depth", {"upto": ("sum", F.col("saved"))})
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ha"), F.col("up_b").alias("hb")).agg(F.count("*").alias("n_children"))
    facts = materialize(above.join(of_leaves, NODE).join(children, NODE, "left").join(_digests(ends), NODE, "left"), "trie-facts")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("up_a"), F.col("hb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return facts.join(parents, ["depth", "up_a", "up_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("of_leaves") - F.col("upto") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuild(materialize(place(convs), "trie-turns"), group, most))


def oracle_sql() -> str:
    return f"""
with {CRC_TABLE},
placed as (select conv_id, {{'role': coalesce(role, ''), 'text': coalesce("text", '')}} as t,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as pos
  from conversations where conv_id is not null),
own as (select conv_id, list(t order by pos) as ts from placed group by conv_id),
cut as (select conv_id, ts, {crc32('conv_id::varchar')} % 6 as h from own, crc_table),
rebuilt as (select c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) as ts
  from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
prefixes as (select conv_id, len(ts) as n, ts, unnest(range(len(ts) + 1)) as depth from rebuilt),
nodes as (select depth, ts[1:depth] as k, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '') as ends, max(n) = depth as leaf,
    (count(*) - 1) * coalesce(length(any_value(ts[depth].text)), 0) as saved
  from prefixes group by 1, 2),
up as (select depth as at, k, conv_id, leaf, saved, unnest(range(depth + 1)) as depth from nodes),
sums as (select depth, k[1:depth] as k, sum(leaf::int) as n_leaves, sum(saved) as saved_tokens from up group by 1, 2),
children as (select depth - 1 as depth, k[1:depth - 1] as k, count(*) as n_children from nodes where depth > 0 group by 1, 2)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join sums s on s.depth = n.depth and s.k = n.k
left join children c on c.depth = n.depth and c.k = n.k
left join nodes p on p.depth = n.depth - 1 and p.k = n.k[1:n.depth - 1]"""
