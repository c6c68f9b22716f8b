"""The line-oriented Java fallback path.

Lines are cut into tokens (words, runs of white space, single other characters),
one row each, and declarations are recognised from a token's neighbours by
windows over its line:

* a method body's ``{`` comes after a parameter list, or after ``throws`` and
  whatever follows it up to the brace; the list's ``(`` comes after a name that
  has white space before it;
* a class body's ``{`` comes after a word ending in ``class``, a name, and an
  ``extends`` name and an ``implements`` clause if there are any.

Imports are matched as text.  Nothing backtracks, so a line of any length is read
in one pass.  ``(?U)`` gives ``\\w``/``\\s`` their Unicode meaning.  The
block-comment state machine of M5 is a window over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?U)\w+|\s+|[^\w\s]"
# the word, white space, then whatever is not a semicolon up to the first one;
# a leading ``static`` is part of the text, its presence is read from the line
IMPORT_RE = r"(?U)import\s++([^;]++);"
# Names the fallback skips, and the modifier words its patterns allow.
SKIP_NAMES = ["if", "while", "for", "switch", "catch"]
METHOD_MODS = "public|private|protected|static"
CLASS_MODS = "public|private|protected|abstract|final"

PY_STRIP = (r"^[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
            r"\x{3000}]+|[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
            r"\x{205F}\x{3000}]+$")


def lines(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))


def _matches(ln: DataFrame, rx: str) -> DataFrame:
    """One row per match: (file, line, k, piece before it, match text, group 1).

    Offsets come from ``split`` pieces: match k starts after pieces 0..k and
    matches 0..k-1, a running sum per line."""
    m = ln.select("file_path", "line_no", "line",
                  F.regexp_extract_all("line", F.lit(rx), 0).alias("ms"),
                  F.regexp_extract_all("line", F.lit(rx), 1).alias("gs"),
                  F.split("line", rx, -1).alias("ps"))
    m = m.where(F.size("ms") > 0).select(
        "file_path", "line_no", "line",
        F.posexplode(F.arrays_zip(F.col("ms").alias("m"), F.col("gs").alias("g"),
                                  F.slice("ps", 1, F.size("ms")).alias("p"))).alias("k", "z"))
    w = Window.partitionBy("file_path", "line_no").orderBy("k")
    before = F.coalesce(F.sum(F.length("z.p") + F.length("z.m")).over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.select("file_path", "line_no", "line", "k", F.col("z.p").alias("piece"), F.col("z.m").alias("m"),
                    F.col("z.g").alias("g"), (before + F.length("z.p")).alias("m_start"))


def _line_tokens(files: DataFrame) -> DataFrame:
    """(file_path, line_no, line, k, tok, off, space, word, brace): the tokens of
    every line, and the first opening brace after each, as (k, end)."""
    t = lines(files).select("file_path", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(TOKEN), 0)).alias("k", "tok"))
    w = Window.partitionBy("file_path", "line_no").orderBy("k")
    size = F.length("tok")
    t = t.withColumns({"off": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size,
                       "space": F.col("tok").rlike(r"^(?U:\s)"), "word": F.col("tok").rlike(r"^(?U:\w)")})
    here = F.when(F.col("tok") == "{", F.struct("k", (F.col("off") + 1).alias("end")))
    return t.withColumn("brace", F.first(here, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def _token(i: int) -> Column:
    """The token ``i`` places further on its line (or back, if negative)."""
    w = Window.partitionBy("file_path", "line_no").orderBy("k")
    cols = F.struct("tok", "space", "word", "off")
    return F.lead(cols, i).over(w) if i > 0 else F.lag(cols, -i).over(w)


def _first_of_each_body(found: DataFrame) -> DataFrame:
    """Of candidates that end at the same brace the leftmost, with ``piece``: the
    text between the declaration before it on the line and itself."""
    w = Window.partitionBy("file_path", "line_no").orderBy("start")
    one = found.groupBy("file_path", "line_no", "end").agg(F.min_by(F.struct("start", "name", "line"), "start").alias("m")).select("file_path", "line_no", "end", "m.*")
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    return one.withColumn("piece", F.substr("line", before + 1, F.col("start") - before))


def methods(files: DataFrame) -> DataFrame:
    """Start column = the leftmost point a declaration can start from: inside
    the trailing run of word/space characters before the name, the first white
    space or modifier-word run followed by white space."""
    t = _line_tokens(files)
    w = Window.partitionBy("file_path", "line_no").orderBy("k")
    t = t.withColumns({f"b{i}": _token(-i) for i in (1, 2, 3)} | {f"a{i}": _token(i) for i in (1, 2, 3, 4, 5)})
    # after a list's end: the brace at once, or ``throws``, white space and something, then the next brace
    gap = F.coalesce(F.col("a1.space"), F.lit(False))
    n1, n2, n3 = (F.when(gap, F.col(f"a{i + 1}")).otherwise(F.col(f"a{i}")) for i in (1, 2, 3))
    throws = (n1["tok"] == "throws") & n2["space"] & (n3["tok"] != "{")
    body = F.when((F.col("tok") == ")") & ((n1["tok"] == "{") | throws), F.col("brace.end"))
    ends = F.first(F.when(F.col("tok") == ")", F.struct(body.alias("end"))), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    spaced = F.coalesce(F.col("b1.space"), F.lit(False))
    name, before = F.when(spaced, F.col("b2")).otherwise(F.col("b1")), F.when(spaced, F.col("b3")).otherwise(F.col("b2"))
    found = (t.select("file_path", "line_no", "line", "tok", name.alias("nm"), before.alias("bf"), ends["end"].alias("end"))
              .where((F.col("tok") == "(") & F.col("nm.word") & F.col("bf.space") & F.col("end").isNotNull())
              .select("file_path", "line_no", "line", F.col("nm.tok").alias("name"), F.col("nm.off").alias("start"), "end"))
    m = _first_of_each_body(found).where(~F.col("name").isin(*SKIP_NAMES))
    run = F.regexp_extract("piece", r"(?U)[\w\s]*+$", 0)
    lead_len = F.length(F.regexp_extract(run, rf"(?U)^([\s\S]*?)(?=\s|(?:{METHOD_MODS})++\s)", 1))
    return m.select("file_path", "name", F.col("line_no").alias("start_line"),
                    (F.col("start") - F.length(run) + lead_len).cast("int").alias("start_column"),
                    F.col("line_no").alias("end_line"), F.col("end").cast("int").alias("end_column"), F.lit(1).alias("complexity"))


def classes(files: DataFrame) -> DataFrame:
    """Start column = start of the modifier/space run right before ``class``."""
    t = _line_tokens(files)
    t = t.withColumns({f"a{i}": _token(i) for i in range(1, 11)})
    at = lambda i: F.col(f"a{i}")

    def opens(i):                                              # the body's brace is token i, or i + 1 after white space
        return (at(i)["tok"] == "{") | (at(i)["space"] & (at(min(i + 1, 10))["tok"] == "{"))

    def implements(i):                                         # white space, the word, white space, something
        return at(i)["space"] & (at(i + 1)["tok"] == "implements") & at(i + 2)["space"] & (at(i + 3)["tok"] != "{")
    extends = at(3)["space"] & (at(4)["tok"] == "extends") & at(5)["space"] & at(6)["word"]
    body = opens(3) | implements(3) | (extends & (opens(7) | implements(7)))
    c = t.where(F.col("tok").endswith("class") & F.col("word") & at(1)["space"] & at(2)["word"] & body & F.col("brace").isNotNull()).select(
        "file_path", "line_no", "line", at(2)["tok"].alias("name"), (F.col("off") + F.length("tok") - 5).alias("start"), F.col("brace.end").alias("end"))
    m = _first_of_each_body(c)
    run = F.regexp_extract("piece", rf"(?U)(?:{CLASS_MODS}|\s)*+$", 0)
    return m.select("file_path", "name", F.col("line_no").alias("start_line"),
                    (F.col("start") - F.length(run)).cast("int").alias("start_column"),
                    F.col("line_no").alias("end_line"), F.col("end").cast("int").alias("end_column"), F.lit(1).alias("complexity"))


def imports(files: DataFrame) -> DataFrame:
    """Raw stripped line as text; ``static`` anywhere in the line → static."""
    m = _matches(lines(files), IMPORT_RE)
    return m.select("file_path", F.regexp_replace("line", PY_STRIP, "").alias("text"),
                    F.col("line_no").alias("start_line"), F.col("m_start").cast("int").alias("start_column"),
                    F.col("line_no").alias("end_line"),
                    (F.col("m_start") + F.length("m")).cast("int").alias("end_column"),
                    F.when(F.col("line").contains("static"), "static").otherwise("regular").alias("type"))


def metrics(files: DataFrame) -> DataFrame:
    """M5: line counts with the block-comment state machine as a window —
    state before a line = last non-null event of the earlier lines."""
    ln = lines(files).select("file_path", "line_no", F.regexp_replace("line", PY_STRIP, "").alias("st"))
    blank = F.col("st") == ""
    sl, sb = F.col("st").startswith("//"), F.col("st").startswith("/*")
    ev = F.when(sb, 1).when(~blank & ~sl & ~sb & F.col("st").contains("*/"), 0)
    w = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(ev, ignorenulls=True).over(w), F.lit(0))
    c = ln.select("*", state.alias("state"))
    is_comment = ~blank & (sl | sb | (F.col("state") == 1))
    return c.groupBy("file_path").agg(
        F.count(F.lit(1)).cast("int").alias("total_lines"),
        F.count(F.when(~blank & ~is_comment, 1)).cast("int").alias("code_lines"),
        F.count(F.when(is_comment, 1)).cast("int").alias("comment_lines"),
        F.count(F.when(blank, 1)).cast("int").alias("blank_lines"),
        F.lit(1.0).alias("average_complexity"))
