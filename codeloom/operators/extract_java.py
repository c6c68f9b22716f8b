"""E14–E18, E22 Java (structural path): methods with bodies, parameters, classes,
direct class methods and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import next_in_subset

# Java words that cannot be a method's return type right before
# its name (statement keywords and modifiers); primitive types and void can.
NOT_TYPE = ["new", "return", "throw", "else", "case", "default", "do", "try", "finally", "package", "import",
            "extends", "implements", "throws", "assert", "break", "continue", "goto", "instanceof", "class",
            "interface", "enum", "record", "yield", "synchronized", "if", "for", "while", "switch", "catch",
            "public", "private", "protected", "static", "final", "abstract", "native", "transient",
            "volatile", "strictfp", "sealed", "permits", "this", "super", "true", "false", "null"]
KEYWORDS = NOT_TYPE + ["void", "int", "long", "short", "byte", "char", "boolean", "float", "double", "var"]
PRIMITIVES = ["int", "long", "short", "byte", "char", "boolean", "float", "double"]

def prepare(s: DataFrame) -> DataFrame:
    """Java rows of the context-enriched token stream (no extra window)."""
    return s.where(F.col("language") == "java")


def _param_list(params_txt: Column) -> Column:
    norm = F.regexp_replace(F.regexp_replace(params_txt, r"\s+", " "), r"@\w+(?:\.\w+)*(?: ?\([^)]*\))? ?", "")
    pieces = F.transform(F.split(F.trim(norm), r",(?![^<>]*(?:<[^<>]*>[^<>]*)*>)"),
                         lambda x: F.regexp_replace(F.trim(x), r"^final\s+", ""))
    rx = r"^(.+?)\s*\b(\w+)((?:\s*\[\s*\])*)$"
    ok = F.filter(pieces, lambda x: x.rlike(rx) & ~x.contains("..."))
    prim = "|".join(PRIMITIVES)

    def render(x):
        t = F.trim(F.regexp_extract(x, rx, 1))
        keep = (t.rlike(r"\]$") | (t.rlike(r"^\w+$") & ~t.rlike(f"^(?:{prim})$")) | t.rlike(r"^[\w.]+\s*<"))
        return F.concat(F.regexp_extract(x, rx, 2), F.lit(": "), F.when(keep, t).otherwise(F.lit("Object")))
    return F.transform(ok, render)


def _declarations(j: DataFrame) -> DataFrame:
    """Method-declaration candidates (``Type name(…)``) with the next ``{``/``;``
    after the parameter list (annotations in it may hold braces)."""
    prv_ok = ((F.col("pkind1") == "word") & ~F.col("prv1").isin(*NOT_TYPE)) | F.col("prv1").isin(">", "]")
    cand = ((F.col("kind") == "word") & ~F.col("text").isin(*KEYWORDS) & (F.col("t1.text") == "(")
            & prv_ok & F.col("t1.close").isNotNull())
    return next_in_subset(j, cand, (F.col("kind") == "punct") & F.col("text").isin("{", ";"), "nb",
                          ["idx", "text", "char_off", "close"], F.col("t1.close.idx"))


def bodiless_methods(j: DataFrame) -> DataFrame:
    """Abstract / interface method declarations (``…);``): not in the method
    list, but they are method declarations, so they count in the average
    complexity with complexity 1."""
    d = _declarations(j)
    return d.where((F.col("nb.text") == ";") & (F.col("nb.idx") > F.col("t1.close.idx"))).select(
        "file_path", "idx", F.lit(1).alias("complexity"))


def methods(j: DataFrame, files_masked: DataFrame) -> DataFrame:
    # A declaration has a body when the next '{' / ';' after its name is a '{'.
    m = _declarations(j)
    m = m.where((F.col("nb.text") == "{") & (F.col("nb.idx") > F.col("t1.close.idx")) & F.col("nb.close").isNotNull())
    cplx = (F.lit(1) + F.col("nb.close.cum_dec") - (F.col("cum_dec") - F.col("dec"))).cast("int")
    jj = m.select("file_path", "idx", "text", "line", "bcol", "end_bcol", "bdepth", "t1", "nb", "decl_start",
                  cplx.alias("complexity")).join(files_masked.select("file_path", "content", "masked"), "file_path")
    params_txt = F.expr("substring(masked, t1.char_end + 1, t1.close.char_off - t1.char_end)")
    return jj.select(
        "file_path", "idx", "bdepth", F.col("text").alias("name"),
        F.col("line").alias("start_line"), F.col("bcol").alias("start_column"),
        F.col("line").alias("end_line"), F.col("end_bcol").alias("end_column"),
        F.coalesce(_param_list(params_txt), F.array().cast("array<string>")).alias("parameters"),
        "complexity",
        F.expr("substring(content, nb.char_off + 1, nb.close.char_end - nb.char_off)").alias("body_text"),
        F.col("decl_start.line").alias("decl_line"), F.col("decl_start.bcol").alias("decl_column"),
        F.col("nb.close.end_line").alias("close_line"), F.col("nb.close.end_bcol").alias("close_column"),
        F.col("nb.close.char_end").alias("close_off"),
        F.expr("substring(content, decl_start.char_off + 1, nb.close.char_end - decl_start.char_off)")
        .alias("decl_text"))


def classes(j: DataFrame, files_masked: DataFrame) -> DataFrame:
    is_cls = ((F.col("text") == "class") & (F.col("kind") == "word")
              & ~F.coalesce(F.col("prv1") == ".", F.lit(False)) & (F.col("t1.kind") == "word"))
    c = next_in_subset(j, is_cls, (F.col("kind") == "punct") & (F.col("text") == "{"), "brace",
                       ["idx", "char_off", "bdepth", "close"]).where(F.col("brace.close").isNotNull())
    cplx = (F.lit(1) + F.col("brace.close.cum_dec") - (F.col("cum_dec") - F.col("dec"))).cast("int")
    cc = c.select("file_path", "idx", "t1", "brace", cplx.alias("complexity")).join(
        files_masked.select("file_path", "content"), "file_path")
    return cc.select("file_path", "idx", F.col("t1.text").alias("name"),
                     F.col("t1.line").alias("start_line"), F.col("t1.bcol").alias("start_column"),
                     F.col("t1.line").alias("end_line"), F.col("t1.end_bcol").alias("end_column"), "complexity",
                     F.col("brace.bdepth").alias("body_depth"), F.col("brace.close.idx").alias("close_idx"),
                     F.expr("substring(content, brace.char_off + 1, brace.close.char_end - brace.char_off)")
                     .alias("body_text"))


def class_methods(meths: DataFrame, classes_df: DataFrame) -> DataFrame:
    """Methods declared directly in a class body: same brace depth as the body,
    owned by the latest class opened at that depth and still open."""
    c = classes_df.select("file_path", "idx", F.col("body_depth").alias("lvl"), F.lit(1).alias("is_cls"),
                          F.struct(F.col("idx").alias("cidx"), F.col("close_idx").alias("cend"),
                                   F.col("name").alias("cname")).alias("cls"))
    m = meths.select("file_path", "idx", F.col("bdepth").alias("lvl"), F.lit(0).alias("is_cls"),
                     F.lit(None).cast(c.schema["cls"].dataType).alias("cls"))
    w = Window.partitionBy("file_path", "lvl").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    own = (c.unionByName(m).select("file_path", "idx", "is_cls", F.last("cls", ignorenulls=True).over(w).alias("o"))
            .where((F.col("is_cls") == 0) & F.col("o").isNotNull() & (F.col("idx") < F.col("o.cend"))))
    r = meths.join(own.select("file_path", "idx", "o").hint("merge"), ["file_path", "idx"])
    return r.select("file_path", F.col("o.cidx").alias("class_idx"), F.col("o.cname").alias("class_name"), "idx",
                    "name", F.col("decl_line").alias("start_line"), F.col("decl_column").alias("start_column"),
                    F.col("close_line").alias("end_line"), F.col("close_column").alias("end_column"),
                    "parameters", "complexity", F.col("decl_text").alias("body_text"))


def imports(j: DataFrame, files_masked: DataFrame) -> DataFrame:
    is_imp = (F.col("text") == "import") & (F.col("kind") == "word") & (F.col("bdepth") == 0)
    im = next_in_subset(j, is_imp, (F.col("kind") == "punct") & (F.col("text") == ";"), "semi",
                        ["idx", "char_off"]).where(F.col("semi").isNotNull())
    start = F.when(F.col("t1.text") == "static", F.col("t2")).otherwise(F.col("t1"))
    jj = im.select("file_path", "idx", start.alias("st"), "semi").join(
        files_masked.select("file_path", "masked"), "file_path")
    raw = F.regexp_replace(F.expr("substring(masked, st.char_off + 1, semi.char_off - st.char_off)"), r"\s+", "")
    name = F.regexp_replace(raw, r"\.\*$", "")
    out = jj.select("file_path", "idx", name.alias("nm"), "st")
    out = out.where(F.col("nm").rlike(r"^\w+(?:\.\w+)+$"))
    return out.select("file_path", "idx", F.concat(F.lit("import "), "nm", F.lit(";")).alias("text"),
                      F.col("st.line").alias("start_line"), F.col("st.bcol").alias("start_column"),
                      F.col("st.line").alias("end_line"),
                      (F.col("st.bcol") + F.octet_length("nm")).cast("int").alias("end_column"),
                      F.lit("regular").alias("type"))
