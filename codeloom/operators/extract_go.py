"""E9–E13 Go: functions (no receiver methods), parameters, structs, fields, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import next_in_subset

def prepare(s: DataFrame) -> DataFrame:
    """Go rows of the context-enriched token stream (no extra window)."""
    return s.where(F.col("language") == "go")


def type_or_any(t: Column) -> Column:
    """Keep identifier / pointer / array / slice types; anything else is interface{}."""
    return F.when(t.rlike(r"^(?:\w+|\*.+|\[.*\].+)$") & ~t.contains("."), t) \
            .when(t.rlike(r"^(?:\*|\[)"), t).otherwise(F.lit("interface{}"))


def split_params(params_txt: Column) -> Column:
    """``name type`` pairs of a parameter list; unnamed and grouped-but-last names drop out."""
    norm = F.trim(F.regexp_replace(params_txt, r"\s+", " "))
    pieces = F.transform(F.split(norm, r",(?![^\[\(\{]*[\]\)\}])"), lambda x: F.trim(x))
    named = F.filter(pieces, lambda x: x.rlike(r"^\w+ [^.]") & ~x.rlike(r"^\w+ \.\.\."))
    return F.transform(named, lambda x: F.concat(F.regexp_extract(x, r"^(\w+)", 1), F.lit(": "),
                                                 type_or_any(F.trim(F.regexp_extract(x, r"^\w+ (.*)$", 1)))))


def functions(g: DataFrame, files_masked: DataFrame) -> DataFrame:
    header = ((F.col("text") == "func") & (F.col("bdepth") == 0) & (F.col("t1.kind") == "word")
              & F.col("t2.text").isin("(", "["))
    # The parameter list comes right after the name, or after the type parameters.
    params = (F.col("text") == "(") & (F.col("prv1") == "]")
    f = next_in_subset(g, header, params, "after_types", ["idx", "text", "char_end", "close"],
                       F.when(F.col("t2.text") == "[", F.col("t2.close.idx")).otherwise(F.col("idx")))
    own = F.struct(*[F.col(f"t2.{c}").alias(c) for c in ("idx", "text", "char_end", "close")])
    f = f.withColumn("params", F.when(F.col("t2.text") == "(", own)
                     .when(F.col("after_types.idx") == F.col("t2.close.idx") + 1, F.col("after_types")))
    f = f.where(F.col("params").isNotNull()).select("file_path", "idx", "params")
    # The body is the first top-level '{' after the header that does not belong
    # to an ``interface{}`` / ``struct{}`` type (subset window).  A line break
    # outside brackets ends the signature, so a '{' of a later logical line
    # belongs to something else and the function has no body.
    body = ((F.col("text") == "{") & (F.col("bdepth") == 1)
            & ~F.coalesce(F.col("prv1").isin("interface", "struct"), F.lit(False)))
    b = next_in_subset(g, header, body, "body", ["idx", "char_off", "close", "ll"])
    f = b.where(F.col("body.ll") == F.col("ll")).join(f, ["file_path", "idx"])
    # An unclosed body (broken file) runs to the end of the file.
    end_cum = F.coalesce(F.col("body.close.cum_dec"), F.col("file_end.cum_dec"))
    cplx = (F.lit(1) + end_cum - (F.col("cum_dec") - F.col("dec"))).cast("int")
    f = f.withColumn("end_off", F.coalesce(F.col("body.close.char_end"), F.col("file_end.char_end"))) \
         .withColumn("end_line", F.coalesce(F.col("body.close.end_line"), F.col("file_end.end_line")))
    j = f.select("file_path", "idx", "line", "t1", "params", "body", "end_off", "end_line",
                 cplx.alias("complexity")).join(
        files_masked.select("file_path", "content", "masked"), "file_path")
    params_txt = F.expr("substring(masked, params.char_end + 1, params.close.char_off - params.char_end)")
    return j.select("file_path", "idx", F.col("t1.text").alias("name"),
                    F.col("t1.line").alias("start_line"), F.col("t1.bcol").alias("start_column"),
                    F.col("t1.line").alias("end_line"), F.col("t1.end_bcol").alias("end_column"),
                    F.coalesce(split_params(params_txt), F.array().cast("array<string>")).alias("parameters"),
                    "complexity",
                    F.expr("substring(content, body.char_off + 1, end_off - body.char_off)").alias("body_text"),
                    F.col("line").alias("span_start_line"), F.col("end_line").alias("span_end_line"))


def structs(g: DataFrame, files_masked: DataFrame) -> DataFrame:
    spec = (F.col("kind") == "word") & ((F.col("prv1") == "type") | F.coalesce(       # or one of a ``type ( … )`` group
        (F.col("bdepth") == 0) & (F.col("typ_grp.o") < F.col("idx")) & (F.col("idx") < F.col("typ_grp.c")), F.lit(False)))
    plain = spec & (F.col("t1.text") == "struct") & (F.col("t2.text") == "{")
    # Type parameters name something and say what it is, ``[K comparable, V any]``;
    # a single length, ``[8]struct{…}``, makes an array type.
    generic = spec & (F.col("t1.text") == "[") & (F.col("t2.kind") == "word") & (
        (F.col("t3.kind") == "word") | F.col("t3.text").isin(",", "~", "["))
    braces = next_in_subset(g, generic, (F.col("text") == "struct") & (F.col("prv1") == "]") & (F.col("t1.text") == "{"),
                            "struct", ["idx", "t1"], F.col("t1.close.idx"))
    cols = ["file_path", "idx", "text", "line", "bcol", "end_bcol", "char_off"]
    st = (g.where(plain).select(*cols, F.col("t2").alias("open"))
           .unionByName(braces.where(F.col("struct.idx") == F.col("t1.close.idx") + 1).select(*cols, F.col("struct.t1").alias("open")))
           .where(F.col("open.close").isNotNull()))
    j = st.join(files_masked.select("file_path", "content", "masked"), "file_path")
    inner = F.expr("substring(masked, open.char_end + 1, open.close.char_off - open.char_end)")
    return j.select("file_path", "idx", F.col("text").alias("name"), F.col("line").alias("start_line"),
                    F.col("bcol").alias("start_column"), F.col("line").alias("end_line"),
                    F.col("end_bcol").alias("end_column"), struct_fields(inner).alias("fields"),
                    F.expr("substring(content, char_off + 1, open.close.char_end - char_off)").alias("body_text"))


FIELD_RE = r"^(\w+(?:\s*,\s*\w+)*)\s+([^`\"\s][^`\"]*?)\s*(`[^`]*`|\"[^\"]*\")?$"


def struct_fields(inner: Column) -> Column:
    lines = F.transform(F.split(inner, r"[\n;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    decl = F.filter(lines, lambda x: x.rlike(FIELD_RE))
    return F.transform(decl, lambda x: F.struct(
        F.regexp_extract(F.regexp_extract(x, FIELD_RE, 1), r"(\w+)$", 1).alias("name"),
        type_or_any(F.regexp_extract(x, FIELD_RE, 2)).alias("type"),
        F.when(F.regexp_extract(x, FIELD_RE, 3).startswith("`"), F.regexp_extract(x, FIELD_RE, 3)).alias("tag")))


def imports(g: DataFrame) -> DataFrame:
    is_path = (F.col("kind") == "str") & F.col("text").startswith('"')
    single = F.col("prv1") == "import"
    aliased_single = (F.col("prv2") == "import") & (F.col("pkind1") == "word") & (F.col("prv1") != "_")
    in_group = (F.col("imp_grp.o") < F.col("idx")) & (F.col("idx") < F.col("imp_grp.c"))
    alias = F.when((F.col("pkind1") == "word") & (F.col("prv1") != "_") & (F.col("prv1") != "import"),
                   F.col("prv1"))
    im = g.where(is_path & (single | aliased_single | F.coalesce(in_group, F.lit(False))))
    path = F.regexp_replace(F.col("text"), r'^"|"$', "")
    return im.select("file_path", "idx",
                     F.concat(F.lit("import "), F.coalesce(F.concat(alias, F.lit(" ")), F.lit("")),
                              F.lit('"'), path, F.lit('"')).alias("text"),
                     F.col("line").alias("start_line"), F.col("bcol").alias("start_column"),
                     F.col("end_line").alias("end_line"), F.col("end_bcol").alias("end_column"),
                     F.when(alias.isNotNull(), "named").otherwise("regular").alias("type"))


def type_declarations(g: DataFrame) -> DataFrame:
    """Every ``type`` declaration (complexity 1: types hold no decision keywords)."""
    return g.where((F.col("text") == "type") & (F.col("kind") == "word")
                   & ~((F.col("prv1") == "(") & (F.col("prv2") == "."))).select(
        "file_path", "idx", F.lit(1).alias("complexity"))
