"""Operator 12: spelling variants by finite-state composition.

Words are counted in one pass over the texts; a task sends on partial counts of
distinct words.  The pairs of vocabulary words that differ by one inserted,
deleted or replaced code point are the paths of

    vocabulary acceptor  o  one-edit transducer  o  vocabulary acceptor

which is enumerated per initial state.  A group of words that share ``left`` as a
beginning and ``right`` as an end is one initial state: its acceptors read what
is between.  Of the shorter word of a pair, of m code points between, one half is
untouched by the edit, so the pair meets in the state that has read the first half or,
from the other end, the last half.  Groups that still hold more than ``GROUP``
words are split in the same way, level by level; once a single code point is left
between, a group holds at most the alphabet and its square, so every group is
bounded, whatever the words.  In a group, both acceptors are minimised
(states of equal right language are one), the transducer's copy transitions walk
both in step, its edit leads to a pair of states, and their common right language
ends the pairs.  Insertions go behind a run of their own letter, so every pair is
accepted along one path only.

Forms are chosen by grouped minima, roots by pointer doubling.

Defined results: null and empty texts have no words; a null id counts as an empty
string before the colon; repeated rows count each; other columns are ignored; an
empty table, or one without frequent words, gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bounded_batches, materialize
from codeloom.llm.oracle_parts import CRC_TABLE, crc32

#: Words that one group may hold, and distinct words that a task holds while counting.
GROUP, HELD = 8192, 200_000
KEY = ["shorter", "left", "right"]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, one_in: int = 199) -> DataFrame:
    """(word, n): occurrences of the letter runs, A-Z lower-cased, of at least
    ``min_length`` code points.  One (document, run) in ``one_in`` loses a code
    point first, as crc32 says."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`").cast("binary")).toDF("id", "text")
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)      # maximal: shorter runs match nowhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py()
                if not raw:
                    continue
                start = zlib.crc32(f"{b.column(0)[i].as_py()}:".encode())
                for word, n in Counter(runs.findall(raw.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def acceptor(words: list[str], states: list[tuple[bool, dict]], known: dict) -> int:
    """Adds the minimised acceptor of sorted, distinct words to ``states``
    (final, transitions) and returns its initial state; equal states are shared."""
    path, last = [[False, []]], ""

    def close(keep: int) -> None:
        while len(path) > keep:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(states)
                states.append((final, dict(arcs)))
            if path:
                path[-1][1].append((last[len(path) - 1], known[key]))
        return known[key] if not keep else None

    for w in words:
        same = 0
        while same < len(last) and same < len(w) and w[same] == last[same]:
            same += 1
        close(same + 1)
        path.extend([False, []] for _ in w[same:])
        path[-1][0], last = True, w
    return close(0)


def compose(words: list[str], m: int) -> list[tuple[str, str]]:
    """Pairs (u, v): u has m code points, v is u with one replaced (v > u) or one
    inserted; both are among ``words`` of m or m + 1 code points."""
    states: list[tuple[bool, dict]] = []
    known: dict = {}
    words = sorted(set(words))
    one, two = acceptor([w for w in words if len(w) == m], states, known), acceptor(words, states, known)
    out = []

    def spell(link) -> str:
        chars = []
        while link:
            link, c = link
            chars.append(c)
        return "".join(reversed(chars))

    def common(p: int, q: int, u, v, but: str | None) -> None:
        """Common right language; its words don't start with ``but``."""
        stack = [(p, q, u, v, but)]
        while stack:
            p, q, u, v, but = stack.pop()
            (end_p, arcs_p), (end_q, arcs_q) = states[p], states[q]
            if end_p and end_q:
                out.append((spell(u), spell(v)))
            for c, r in arcs_p.items():
                if c in arcs_q and c != but:
                    stack.append((r, arcs_q[c], (u, c), (v, c), None))

    stack = [(one, two, ())]
    while stack:
        p, q, read = stack.pop()
        arcs_p, arcs_q = states[p][1], states[q][1]
        for c, s in arcs_q.items():
            common(p, s, read, (read, c), c)                   # inserted
            if c in arcs_p:
                stack.append((arcs_p[c], s, (read, c)))        # copied
            for d, r in arcs_p.items():
                if d < c:
                    common(r, s, (read, d), (read, c), None)   # replaced
    return out


def _halves(groups: DataFrame) -> DataFrame:
    """Each word of each group in the two groups that have read one half more."""
    m = F.col("shorter") - F.length("left") - F.length("right")
    half = F.floor(m / 2).cast("int")
    rest = (m - half).cast("int")
    n = F.length("rest")
    first = F.struct("shorter", F.concat("left", F.substr("rest", F.lit(1), half)).alias("left"), F.col("right"), F.substr("rest", half + 1, n).alias("rest"))
    last = F.struct("shorter", F.col("left"), F.concat(F.substr("rest", n - rest + 1, rest), "right").alias("right"), F.substr("rest", F.lit(1), n - rest).alias("rest"))
    return groups.select(F.explode(F.array(first, last)).alias("g")).select("g.*")


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, other), both ways: the words (column ``word``, distinct) that differ by one edit."""
    n = F.length("word")
    sizes = F.array(n, n - 1)                                  # code points of the pair's shorter word
    start = words.select(F.explode(sizes).alias("shorter"), F.col("word").alias("rest")).filter("shorter > 0")
    groups = materialize(_halves(start.select("shorter", F.lit("").alias("left"), F.lit("").alias("right"), "rest")), "spelling-groups")
    between = F.col("shorter") - F.length("left") - F.length("right")
    pairs = None
    while True:
        sizes = materialize(groups.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1"), "spelling-sizes")
        large = (F.col("n") > group) & (between > 1)
        fits = groups.join(sizes.filter(~large), KEY).groupBy(*KEY).agg(F.collect_list("rest").alias("words"))
        found = fits.mapInArrow(_compose_groups, "word string, other string")
        pairs = materialize(found if pairs is None else pairs.unionByName(found), "spelling-pairs")
        if sizes.filter(large).isEmpty():
            break
        groups = materialize(_halves(groups.join(sizes.filter(large), KEY).select(*KEY, "rest")), "spelling-groups")
    once = materialize(pairs.distinct(), "spelling-near")
    return once.unionByName(once.select(F.col("other").alias("word"), F.col("word").alias("other")))


def _compose_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = [], []
        for i in range(b.num_rows):
            shorter, left, right, words = (b.column(k)[i].as_py() for k in range(4))
            for x, y in compose(words, shorter - len(left) - len(right)):
                u.append(f"{left}{x}{right}")
                v.append(f"{left}{y}{right}")
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string())], names=["word", "other"])


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain ``word`` -> ``form``, by doubling."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.filter("moved").isEmpty():
            return up
        up = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word.  The form is the
    near word of largest n (ties: smallest in code-point order) if that is at
    least ``factor`` times the word's n; the root is where forms lead."""
    words = materialize(count_words(docs, id_col, text_col, min_length).filter(F.col("n") >= min_count), "spelling-words")
    near = near_words(words.select("word")).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    formed = words.join(best, "word", "left")
    good = -F.col("best.m") >= factor * F.col("n")
    formed = materialize(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "spelling-forms")
    roots = follow(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with recursive {CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate("text", '{upper}', '{lower}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by 1, 2),
hashed as (select run, n, {crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from counted, crc_table),
words as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n
  from hashed group by 1 having length(word) >= 6 and sum(n) >= 5),
cut as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, unnest(range(length(word))) as i from words)),
near as (select c.word, w.word as other from cut c join words w on w.word = c.rest
  union select w.word, c.word from cut c join words w on w.word = c.rest
  union select a.word, b.word from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
best as (select near.word, count(*) as n_near, min(struct_pack(m := -w.n, other := near.other)) as best from near join words w on w.word = near.other group by 1),
formed as (select words.word, words.n, coalesce(n_near, 0)::bigint as n_near, case when -best.m >= 5 * words.n then best.other end as form,
  case when -best.m >= 5 * words.n then -best.m end as form_n from words left join best on best.word = words.word),
chain as (select word, form, word as root, form as up from formed
  union all select chain.word, chain.form, f.word, f.form from chain join formed f on f.word = chain.up)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from formed f join chain c on c.word = f.word and c.up is null"""
