"""Files → the relevant tokens with positions, nesting and context.

* X0 tokenise: one linear regex per language (possessive / unrolled loops only,
  last alternative ``[\\s\\S]`` so every character lands somewhere).  Each
  match is ``(trivia)(token)``: whitespace, newlines and comments are folded
  into the significant token after them, so there is one token per word, string
  or punctuation mark; strings are single tokens and comments never become
  tokens, so keywords inside them never count.
* X1 positions, X2 nesting, X3 decisions and the neighbours: running values over
  a file's tokens, computed by array operations over a batch of files
  (``token_context``).  The complexity of any span is ``1 + cum(end) -
  cum(before start)`` — no range join.

Files are dealt and sorted by ``file_path`` once, and only the tokens that an
extractor reads are written, bucketed by file; every later window and join is
partitioned by ``file_path``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import bounded_batches, materialize
from .token_context import SCHEMA, Context

# Decision keywords counted by the complexity score, per language
# (the tree node types if/elif/else/for/while/case/catch/except that exist in each).
DECISIONS = {
    "python": ["if", "elif", "else", "for", "while", "except", "case"],
    "go": ["if", "else", "for", "case"],
    "java": ["if", "else", "for", "while", "case", "catch"],
}

_DQ_PY3 = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
_SQ_PY3 = r"'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
_BLOCK = r"/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"

# Trivia (whitespace, newlines, comments, Python line continuations) is folded
# into the token that follows it: one row per significant token.
TRIVIA_RE = {
    "python": r"(?:[ \t\f\r\n]++|\\\r?\n|#[^\n]*+)*+",
    "go": r"(?:[ \t\f\r\n]++|//[^\n]*+|" + _BLOCK + r")*+",
    "java": r"(?:[ \t\f\r\n]++|//[^\n]*+|" + _BLOCK + r")*+",
}
TOKEN_RE = {
    "python": "(?:[rRbBuUfF]{1,2})?(?:" + _SQ_PY3 + "|" + _DQ_PY3 + "|" + _SQ + "|" + _DQ + r")|(?U:\w++)|[\s\S]",
    "go": r"`[^`]*+`?|" + _DQ + "|" + _SQ + r"|(?U:\w++)|[\s\S]",
    "java": _DQ_PY3 + "|" + _DQ + "|" + _SQ + r"|(?U:\w++)|[\s\S]",
}
# Trailing trivia at the end of a file matches an empty token (``\z``), so a
# final comment is consumed as trivia instead of being re-scanned from inside.
PIECE_RE = {lang: f"({TRIVIA_RE[lang]})({TOKEN_RE[lang]}|\\z)" for lang in TOKEN_RE}


def _pieces(content: Column, language: Column, group: int, patterns: dict[str, str] | None = None) -> Column:
    expr = None
    for lang, rx in (patterns or PIECE_RE).items():
        t = F.regexp_extract_all(content, F.lit(rx), group)
        expr = F.when(language == lang, t) if expr is None else expr.when(language == lang, t)
    return expr


def token_table(files: DataFrame, num_partitions: int | None = None, rules=()) -> tuple[DataFrame, DataFrame]:
    """Return ``(s, files_masked)``.

    ``s`` holds one row per relevant token (``token_context.SCHEMA``) with
    positions, depths, decision counts, neighbours (``nxt1``, ``prv1..2``, ``t1..t3``
    with their bracket match), ``prev_end`` and ``file_end`` (ends of the previous
    and the last token), ``stmt`` and ``stmt_no`` (first token and number of the
    statement), ``imp_grp`` and ``typ_grp`` (the latest ``import ( … )`` and ``type
    ( … )`` group, Go) and ``decl_start`` (first token after the latest ``; { }``,
    Java); ``files_masked`` has the content with trivia blanked and
    ``file_balanced`` (E22, null without Java tokens) beside it.  Both are
    one written table, bucketed by ``file_path``.  ``rules`` (of language_rules) add
    languages."""
    from .language_rules import piece_pattern, trivia_pattern

    spark = files.sparkSession
    bounded_batches(spark)
    patterns = PIECE_RE | {r.name: piece_pattern(r) for r in rules}
    context = Context({**{k: tuple(v) for k, v in DECISIONS.items()}, **{r.name: tuple(r.decisions) for r in rules}},
                      {"python": "#", **{r.name: r.line_comment for r in rules if r.blocks == "indent"}},
                      tuple(w for r in rules for w in r.words), TRIVIA_RE | {r.name: trivia_pattern(r) for r in rules}, to_arrow_schema(StructType.fromDDL(SCHEMA)))
    # An explicit count: AQE must not coalesce this exchange into a handful of
    # tasks, because what follows is CPU-bound.
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = (files.select("file_path", "language", "content").repartition(n, "file_path").sortWithinPartitions("file_path")
                   .select("*", _pieces(F.col("content"), F.col("language"), 0, patterns).alias("pieces")))
    # A folder for each language and kind of row: an extractor reads its language's
    # tokens, and what needs the text reads the files' rows.
    rows = pieces.mapInArrow(context, SCHEMA).withColumn("is_token", F.col("idx") >= 0)
    t = materialize(rows, "tokens", "file_path", n, ("language", "is_token"))
    return t.where("is_token").drop("content", "masked", "is_token"), t.where("not is_token").select("file_path", "language", "content", "masked", "file_balanced")


def _struct(fields: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(c) for c in fields])


def next_in_subset(df: DataFrame, anchor: Column, target: Column, name: str, fields: list[str],
                   after: Column | None = None) -> DataFrame:
    """Anchor rows only, each with the nearest *following* target row (a struct
    of ``fields``); with ``after``, the nearest one past that token number.  The window runs over anchors ∪ targets — a small subset of
    the token stream — with a running ``last`` in descending order (O(n))."""
    pos = F.col("idx") if after is None else F.when(anchor, after).otherwise(F.col("idx"))
    sub = df.where(anchor | target).withColumn("__a", anchor).withColumn("__t", target).withColumn("__p", pos)
    w = (Window.partitionBy("file_path").orderBy(F.col("__p").desc())
               .rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.last(F.when(F.col("__t"), _struct(fields)), ignorenulls=True).over(w)
    return sub.withColumn(name, nxt).where(F.col("__a")).drop("__a", "__t", "__p")
