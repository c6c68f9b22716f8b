"""A language as data.

A :class:`LanguageRule` is one row of plain values: what comments and strings look
like, which words decide, which words come before the names of functions, types
and structs, what begins an import, and whether blocks are braces or indents.
Rules are compiled into the same expressions that the built-in languages use: the
tokenising pattern, the decision words, the windows that find a header's
parameter list and body, and the comment prefixes of the line metrics.  So a
language that is added by a row takes part in the one tokenisation and its records
have the same schema; no code is written for it.

Braces: a function or type is a header word, a name, for functions a parameter list
(after type parameters, if any), and the next ``{`` before a ``;`` or another header;
where lines end statements, a function's is on the line that closes its list.
Methods of a type are the functions directly in its body.  Indents: as for Python
(block ends from the indents of logical lines), with the rule's words.

Known limits: a type whose name does not follow its word at once (``impl<T> A``) is
not seen, macros and preprocessors are not expanded, and parameters are taken apart
as ``name``, ``name: type`` or ``type name`` text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import extract_java as XJ
from . import extract_python as XP
from .tokens import next_in_subset


@dataclass(frozen=True)
class LanguageRule:
    name: str
    functions: tuple[str, ...]
    types: tuple[str, ...] = ()
    structs: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    decisions: tuple[str, ...] = ()
    blocks: str = "braces"                     # or "indent"
    ends: str = ";"                            # what ends a statement: ";" or "line"
    line_comment: str = "//"
    block_comment: tuple[str, ...] = ("/*", "*/")      # empty: there is none
    strings: tuple[str, ...] = ('"',)          # delimiters; a tripled one spans lines
    multiline: bool = False                    # the others may span lines, too
    characters: bool = False                   # 'x' is a character, and ' may stand alone

    @staticmethod
    def rows(table: DataFrame) -> list[LanguageRule]:
        """Rules from a table with these columns (arrays for tuples; missing
        columns and nulls mean the default).  A row for each language: few."""
        names = [f.name for f in fields(LanguageRule) if f.name in table.columns]
        out = []
        for r in table.select(*names).collect():
            values = {n: tuple(r[n]) if isinstance(r[n], list) else r[n] for n in names if r[n] is not None}
            out.append(LanguageRule(**values))
        return out

    @property
    def words(self) -> list[str]:
        return [*self.functions, *self.types, *self.structs, *self.imports]


def trivia_pattern(rule: LanguageRule) -> str:
    """White space and comments before a token (the same in Java's and Python's patterns)."""
    parts = [r"[ \t\f\r\n]++"]
    if rule.blocks == "indent":
        parts.append(r"\\\r?\n")
    parts.append(re.escape(rule.line_comment) + r"[^\n]*+")
    if rule.block_comment:
        start, end = rule.block_comment
        first, rest = re.escape(end[0]), re.escape(end[1:])
        inner = rf"[^{first}]++|{first}(?!{rest})" if rest else rf"[^{first}]++"
        parts.append(rf"{re.escape(start)}(?:{inner})*+{re.escape(end)}")
    return "(?:" + "|".join(parts) + ")*+"


def _string(delimiter: str, multiline: bool) -> str:
    d = re.escape(delimiter[0])
    if len(delimiter) == 3:
        return rf"{d}{{3}}(?:[^{d}\\]++|\\[\s\S]|{d}(?!{d}{d}))*+{d}{{3}}"
    line = "" if multiline else r"\n"
    return rf"{d}(?:[^{d}\\{line}]++|\\[\s\S])*+{d}?"


def piece_pattern(rule: LanguageRule) -> str:
    """``(trivia)(token)``, as tokens.PIECE_RE has it for the built-in languages."""
    strings = [_string(d, rule.multiline) for d in sorted(rule.strings, key=len, reverse=True)]
    if rule.characters:
        strings.append(r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,9}+)'")
    tokens = [*strings, r"(?U:\w++)", r"[\s\S]"]
    return f"({trivia_pattern(rule)})({'|'.join(tokens)}|\\z)"


def _stops(rule: LanguageRule) -> Column:
    """``{``, ``;`` and headers: what the body of a header is looked for among."""
    words = (F.col("kind") == "word") & F.col("text").isin(*rule.functions, *rule.types, *rule.structs) & (F.col("t1.kind") == "word")
    return ((F.col("kind") == "punct") & F.col("text").isin("{", ";")) | words


def _header_end(g: DataFrame, header: Column, rule: LanguageRule, after: Column | None = None, line: Column | None = None) -> DataFrame:
    """Headers with ``body``, the ``{`` that belongs to them: the next one before a
    ``;`` or another header, on the line ``line`` if lines end statements."""
    f = next_in_subset(g, header, _stops(rule), "body", ["idx", "text", "char_off", "close", "line", "bdepth"], after)
    own = (F.col("body.text") == "{") & F.col("body.close").isNotNull()
    return f.where(own & (F.col("body.line") == line) if rule.ends == "line" and line is not None else own)


def _parameters(text: Column) -> Column:
    pieces = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r",(?![^\[\(\{<]*[\]\)\}>])"),
                         lambda x: F.trim(F.regexp_replace(x, r"\s*=.*$", "")))
    return F.filter(pieces, lambda x: x.rlike(r"^\w+$") | x.rlike(r"^(?:\w+ )?\w+\s*:\s*\S") | x.rlike(r"^[\w.<>\[\], *&]+ \w+$"))


def _at(c: str) -> list[Column]:
    return [F.col(f"{c}.line").alias("start_line"), F.col(f"{c}.bcol").alias("start_column"),
            F.col(f"{c}.line").alias("end_line"), F.col(f"{c}.end_bcol").alias("end_column")]


def _brace_functions(g: DataFrame, fm: DataFrame, rule: LanguageRule) -> DataFrame:
    header = (F.col("kind") == "word") & F.col("text").isin(*rule.functions) & (F.col("t1.kind") == "word")
    opening = (F.col("text") == "(") & F.col("prv1").isin(">", "]")
    f = next_in_subset(g, header, opening, "generic", ["idx", "char_end", "close"])
    own = F.struct(*[F.col(f"t2.{c}").alias(c) for c in ("idx", "char_end", "close")])
    f = f.withColumn("params", F.when(F.col("t2.text") == "(", own).when(F.col("t2.text").isin("<", "["), F.col("generic")))
    params = f.where(F.col("params.close").isNotNull()).select("file_path", "idx", "params")
    # the header rows once more, with their parameter lists as where the body is looked
    # for; rows that are neither headers nor stops would only be sorted for the join
    h = g.where(header | _stops(rule)).join(params, ["file_path", "idx"], "left")
    b = _header_end(h, F.col("params").isNotNull(), rule, F.col("params.close.idx"), F.col("params.close.end_line"))
    cplx = (F.lit(1) + F.col("body.close.cum_dec") - (F.col("cum_dec") - F.col("dec"))).cast("int")
    j = b.select("file_path", "idx", "line", "bcol", "char_off", "bdepth", "t1", "params", "body", cplx.alias("complexity")).join(
        fm.select("file_path", "content", "masked"), "file_path")
    text = F.expr("substring(masked, params.char_end + 1, params.close.char_off - params.char_end)")
    return j.select(
        "file_path", "idx", "bdepth", F.col("t1.text").alias("name"), *_at("t1"),
        F.coalesce(_parameters(text), F.array().cast("array<string>")).alias("parameters"), "complexity",
        F.expr("substring(content, body.char_off + 1, body.close.char_end - body.char_off)").alias("body_text"),
        F.col("line").alias("decl_line"), F.col("bcol").alias("decl_column"),
        F.col("body.close.end_line").alias("close_line"), F.col("body.close.end_bcol").alias("close_column"),
        F.expr("substring(content, char_off + 1, body.close.char_end - char_off)").alias("decl_text"))


def _brace_types(g: DataFrame, fm: DataFrame, rule: LanguageRule, words: tuple[str, ...]) -> DataFrame:
    header = (F.col("kind") == "word") & F.col("text").isin(*words) & (F.col("t1.kind") == "word")
    b = _header_end(g, header, rule)
    cplx = (F.lit(1) + F.col("body.close.cum_dec") - (F.col("cum_dec") - F.col("dec"))).cast("int")
    j = b.select("file_path", "idx", "t1", "body", cplx.alias("complexity")).join(fm.select("file_path", "content", "masked"), "file_path")
    return j.select("file_path", "idx", F.col("t1.text").alias("name"), *_at("t1"), "complexity",
                    F.col("body.bdepth").alias("body_depth"), F.col("body.close.idx").alias("close_idx"),
                    F.expr("substring(content, body.char_off + 1, body.close.char_end - body.char_off)").alias("body_text"),
                    F.expr("substring(masked, body.char_off + 2, body.close.char_end - body.char_off - 2)").alias("inner"))


FIELD = r"^(?:\w+(?:\([^)]*\))?\s+)*?(\w+)\s*:\s*(\S.*)$"


def _fields(inner: Column) -> Column:
    pieces = F.transform(F.split(inner, r"\n|;|,(?![^\[\(\{<\n]*[\]\)\}>])"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(F.filter(pieces, lambda x: x.rlike(FIELD)), lambda x: F.struct(
        F.regexp_extract(x, FIELD, 1).alias("name"), F.regexp_extract(x, FIELD, 2).alias("type"), F.lit(None).cast("string").alias("tag")))


def _imports(g: DataFrame, fm: DataFrame, rule: LanguageRule) -> DataFrame:
    """A statement from its import word to its end, white space made single."""
    starts = (F.col("kind") == "word") & F.col("text").isin(*rule.imports) & (
        F.col("ll_start") | F.coalesce(F.col("prv1").isin(";", "{", "}"), F.lit(False)))
    if rule.ends == "line":
        g = g.withColumn("end", F.struct(F.col("prev_end.char_end").alias("char_end"), F.col("prev_end.end_line").alias("end_line"), F.col("prev_end.end_bcol").alias("end_bcol")))
        i = next_in_subset(g, starts, F.col("ll_start"), "stop", ["end"])
        end = F.coalesce("stop.end", F.struct(*[F.col(f"file_end.{c}").alias(c) for c in ("char_end", "end_line", "end_bcol")]))
    else:
        g = g.withColumn("end", F.struct(F.col("char_off").alias("char_end"), F.col("line").alias("end_line"), F.col("bcol").alias("end_bcol")))
        i = next_in_subset(g, starts, (F.col("kind") == "punct") & (F.col("text") == ";"), "stop", ["end"]).where(F.col("stop").isNotNull())
        end = F.col("stop.end")
    j = i.select("file_path", "idx", "char_off", "t1", end.alias("end")).where(F.col("t1").isNotNull()).join(fm.select("file_path", "masked"), "file_path")
    text = F.expr("substring(masked, char_off + 1, end.char_end - char_off)")
    return j.select("file_path", "idx", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), F.col("t1.line").alias("start_line"), F.col("t1.bcol").alias("start_column"),
                    F.col("end.end_line").alias("end_line"), F.col("end.end_bcol").cast("int").alias("end_column"), F.lit("regular").alias("type"))


CLASS = ["file_path", "idx", "name", "start_line", "start_column", "end_line", "end_column", "complexity", "body_text"]


def extract(s: DataFrame, fm: DataFrame, rule: LanguageRule) -> dict[str, DataFrame]:
    """functions, classes, methods, structs and imports of one language's files,
    from the context-enriched tokens ``s`` and the masked files ``fm``."""
    g = s.where(F.col("language") == rule.name)
    imports = _imports(g, fm, rule)
    no_structs = s.sparkSession.createDataFrame([], "file_path string, idx int, name string, start_line int, start_column int, end_line int, end_column int").select(
        "*", F.array().cast(schemas.STRUCT["fields"].dataType).alias("fields"), F.lit("").alias("body_text"))
    if rule.blocks == "indent":
        f, c = XP.split_definitions(XP.definitions(g, fm, rule.functions, (*rule.types, *rule.structs)))
        m = XP.class_methods(f, c)
        f = f.withColumnsRenamed({"def_line": "decl_line", "blk_end_line": "close_line"})
        return {"functions": f, "classes": c.select(CLASS), "methods": m, "structs": no_structs, "imports": imports}
    f = _brace_functions(g, fm, rule)
    t = _brace_types(g, fm, rule, rule.types) if rule.types else _brace_types(g.limit(0), fm, rule, ("",))
    st = _brace_types(g, fm, rule, rule.structs).withColumn("fields", _fields(F.col("inner")).cast(schemas.STRUCT["fields"].dataType)) if rule.structs else None
    return {"functions": f, "classes": t.select(CLASS), "methods": XJ.class_methods(f, t),
            "structs": no_structs if st is None else st.select(no_structs.columns), "imports": imports}


def comment_lines(rule: LanguageRule) -> str:
    """What a comment line starts with, as a regex alternation."""
    return "|".join(re.escape(x) for x in (rule.line_comment, *rule.block_comment[:1]))
