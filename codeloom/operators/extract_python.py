"""E4–E8 Python: functions, parameters, classes, direct methods, imports.

Works on the significant-token rows of :mod:`codeloom.operators.tokens`.
Block ends come from indentation: the block of a header with indent I ends
before the next logical line with indent <= I.  That "next smaller-or-equal"
lookup is a window per ``(file, level)``: the first of a run of logical lines is a
closer for every header level >= its indent (levels = the distinct header indents
of the file, a handful), and a header takes the nearest closer after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import next_in_subset

def prepare(s: DataFrame) -> DataFrame:
    """Python rows of the context-enriched token stream (no extra window)."""
    return s.where(F.col("language") == "python")


DEFS, CLASSES = ("def",), ("class",)


def headers(p: DataFrame, defs: tuple[str, ...] = DEFS, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Logical-line rows, with block end for ``def`` / ``class`` headers (or
    those of another language with indented blocks)."""
    is_def = F.col("text").isin(*defs) | ((F.col("text") == "async") & F.col("nxt1").isin(*defs))
    is_cls = F.col("text").isin(*classes)
    ll = (p.where(F.col("ll_start"))
           .withColumn("htype", F.when(is_def, "def").when(is_cls, "class"))
           .withColumn("indent", F.col("ccol")))
    wl = Window.partitionBy("file_path").orderBy("idx")
    ll = ll.select("*",
                   F.lag("text").over(wl).alias("prev_ll_text"),
                   F.lag("indent").over(wl).alias("prev_ll_indent"),
                   F.lag("htype").over(wl).isNotNull().alias("after_header"), F.lag("idx").over(wl).alias("prev_ll_idx"),
                   F.lead("indent").over(wl).alias("next_ll_indent"),
                   F.collect_set(F.when(F.col("htype").isNotNull(), F.col("indent")))
                    .over(wl.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("levels"))
    # Of a run of lines that could close a level the first does: the line before it is
    # deeper, or a header of that level.  (Where a path has several rows, so that token
    # numbers repeat, every line counts.)
    repeats = F.max(F.col("idx") == F.col("prev_ll_idx")).over(wl.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = lambda v: ((v < F.col("prev_ll_indent")) | ((v == F.col("prev_ll_indent")) & F.col("after_header"))
                       | F.coalesce("repeats", F.lit(False)))
    closers = ll.withColumn("repeats", repeats).select(
        "file_path", "idx", F.explode(F.filter("levels", lambda v: (v >= F.col("indent")) & first(v))).alias("lvl"), F.lit(0).alias("is_hdr"), "prev_end")
    # Block start = token after the first bracket-depth-0 ':' following the
    # header: a subset window over headers and depth-0 colons only.
    colon = (F.col("text") == ":") & (F.col("adepth") == 0)
    hc = next_in_subset(p.withColumn("nxt_off", F.col("t1.char_off")),
                        F.col("ll_start") & (is_def | is_cls), colon, "colon", ["idx", "nxt_off"])
    hdrs = ll.where(F.col("htype").isNotNull()).join(hc.select("file_path", "idx", "colon"), ["file_path", "idx"])
    u = closers.unionByName(hdrs.select("file_path", "idx", F.col("indent").alias("lvl"), F.lit(1).alias("is_hdr"),
                                        F.lit(None).cast(closers.schema["prev_end"].dataType).alias("prev_end")))
    wu = (Window.partitionBy("file_path", "lvl").orderBy(F.col("idx").desc(), F.col("is_hdr").desc())
                .rowsBetween(Window.unboundedPreceding, -1))
    nearest = F.min(F.when(F.col("is_hdr") == 0, F.struct(F.col("idx").alias("k"), F.col("prev_end").alias("e"))))
    ends = (u.select("file_path", "idx", "is_hdr", nearest.over(wu).alias("nc"))
             .where(F.col("is_hdr") == 1).select("file_path", "idx", F.col("nc.k").alias("end_ll_idx"),
                                                  F.col("nc.e").alias("blk_end")))
    # rows of every file on all sides: none is a side to broadcast
    h = hdrs.join(ends.hint("merge"), ["file_path", "idx"]).join(_cases_within(ends, case_clauses(ll)).hint("merge"), ["file_path", "idx"], "left")
    return h.withColumn("blk_end", F.coalesce("blk_end", "file_end")), ll


def case_clauses(ll: DataFrame) -> DataFrame:
    """(file_path, idx) of the logical lines that open a clause of a ``match``
    statement.  ``case`` is a soft keyword: a line that starts with it is a clause
    only if the nearest line above with a smaller indent is a ``match`` header.

    Like block ends, that is a window per ``(file, level)``: the levels are the
    indents of the ``match`` bodies of a file (none in most files), a ``match``
    header opens its level, and any other line with a smaller indent closes it."""
    w = Window.partitionBy("file_path").orderBy("idx")
    x = ll.select("file_path", "idx", "text", "indent", F.lead("prv1").over(w).alias("ends_in"),
                  F.lead("text").over(w).alias("then"), F.lead("indent").over(w).alias("body"))
    header = (F.col("text") == "match") & (F.col("ends_in") == ":") & (F.col("then") == "case") & (F.col("body") > F.col("indent"))
    x = x.withColumn("body", F.when(header, F.col("body")))
    levels = F.collect_set("body").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    u = x.withColumn("levels", levels).select("file_path", "idx", "text", "indent", "body", F.explode(
        F.filter("levels", lambda v: v >= F.col("indent"))).alias("lvl"))
    opened = F.when(F.col("body") == F.col("lvl"), 1).when(F.col("indent") < F.col("lvl"), 0)
    wl = Window.partitionBy("file_path", "lvl").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return (u.withColumn("inside", F.last(opened, ignorenulls=True).over(wl))
             .where((F.col("text") == "case") & (F.col("indent") == F.col("lvl")) & (F.col("inside") == 1)).select("file_path", "idx"))


def _cases_within(ends: DataFrame, cases: DataFrame) -> DataFrame:
    """(file_path, idx, n_cases): clauses inside each header's block — how many
    there are before its end less how many before its start, both read from one
    running count over blocks' ends and clauses."""
    bounds = F.explode(F.array(F.struct(F.col("idx").alias("at"), F.lit(-1).alias("sign")),
                               F.struct(F.coalesce("end_ll_idx", F.lit(2**31 - 1)).alias("at"), F.lit(1).alias("sign"))))
    events = (ends.select("file_path", "idx", bounds.alias("b")).select("file_path", "idx", "b.at", "b.sign", F.lit(0).alias("clause"))
              .unionByName(cases.select("file_path", F.lit(None).cast("int").alias("idx"), F.col("idx").alias("at"), F.lit(None).cast("int").alias("sign"), F.lit(1).alias("clause"))))
    w = Window.partitionBy("file_path").orderBy("at", "clause").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (events.withColumn("before", F.sum("clause").over(w)).where("sign is not null")
                  .groupBy("file_path", "idx").agg(F.sum(F.col("sign") * F.col("before")).alias("n_cases")))


def functions(p: DataFrame, files_masked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ``def``s (top level, nested, methods) and all classes, flat rows."""
    return split_definitions(definitions(p, files_masked))


def split_definitions(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    return out.where(F.col("htype") == "def").drop("htype"), out.where(F.col("htype") == "class").drop("htype")


def definitions(p: DataFrame, files_masked: DataFrame, defs: tuple[str, ...] = DEFS, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``def`` and ``class`` headers with names, spans, parameters and texts
    (``htype`` tells them apart)."""
    h, ll = headers(p, defs, classes)
    is_async = F.col("text") == "async"
    name = F.when(is_async, F.col("t2")).otherwise(F.col("t1"))
    paren = F.when(is_async, F.col("t3")).otherwise(F.col("t2"))
    body_start = F.col("colon.nxt_off")
    start_dec = F.col("cum_dec") - F.col("dec")
    cplx = (F.lit(1) + F.col("blk_end.cum_dec") - start_dec + F.coalesce("n_cases", F.lit(0))).cast("int")
    decorated = F.col("prev_ll_text") == "@"
    base = h.select("file_path", "htype", "idx", "indent", "line", "bcol", "char_off",
                    name.alias("nm"), paren.alias("pr"), body_start.alias("body_start"), "blk_end",
                    cplx.alias("complexity"), decorated.alias("decorated"), "next_ll_indent")
    fm = files_masked.select("file_path", "content", "masked")
    j = base.join(fm, "file_path")
    params_txt = F.when(F.col("pr.text") == "(",
                        F.expr("substring(masked, pr.char_end + 1, pr.close.char_off - pr.char_end)"))
    no_str = F.regexp_replace(params_txt, r"[rRbBuUfF]{0,2}(?:\"[^\"\\\\]*+(?:\\\\.[^\"\\\\]*+)*+\"|'[^'\\\\]*+(?:\\\\.[^'\\\\]*+)*+')", "S")
    pieces = F.split(F.regexp_replace(no_str, r"\s+", " "), r",(?![^\[\(\{]*[\]\)\}])")
    keep = F.filter(F.transform(pieces, lambda x: F.trim(x)),
                    lambda x: x.rlike(r"^\w+$") | x.rlike(r"^\w+\s*:[^=]*$"))
    params = F.transform(keep, lambda x: F.regexp_extract(x, r"^(\w+)", 1))
    body = F.expr("substring(content, body_start + 1, blk_end.char_end - body_start)")
    whole = F.expr("substring(content, char_off + 1, blk_end.char_end - char_off)")
    out = j.select(
        "file_path", "htype", "idx", "indent", "decorated", "next_ll_indent",
        F.col("nm.text").alias("name"),
        F.col("nm.line").alias("start_line"), F.col("nm.bcol").alias("start_column"),
        F.col("nm.line").alias("end_line"), F.col("nm.end_bcol").alias("end_column"),
        F.col("line").alias("def_line"), F.col("bcol").alias("def_column"),
        F.col("blk_end.end_line").alias("blk_end_line"), F.col("blk_end.end_bcol").alias("blk_end_column"),
        F.col("blk_end.char_end").alias("blk_end_off"),
        F.coalesce(params, F.array().cast("array<string>")).alias("parameters"),
        "complexity", body.alias("body_text"), whole.alias("def_text"))
    return out


def class_methods(funcs: DataFrame, classes: DataFrame) -> DataFrame:
    """Direct, undecorated ``def``s of each class body: a def belongs to the most
    recent class (same file) whose body indent equals the def's indent, if the
    def lies inside that class block."""
    c = classes.where(F.col("next_ll_indent") > F.col("indent")).select(
        "file_path", "idx", F.col("next_ll_indent").alias("lvl"), F.lit(1).alias("is_cls"),
        F.struct(F.col("idx").alias("cidx"), F.col("blk_end_off").alias("cend"),
                 F.col("name").alias("cname")).alias("cls"))
    d = funcs.select("file_path", "idx", F.col("indent").alias("lvl"), F.lit(0).alias("is_cls"),
                     F.lit(None).cast(c.schema["cls"].dataType).alias("cls"))
    w = (Window.partitionBy("file_path", "lvl").orderBy("idx")
               .rowsBetween(Window.unboundedPreceding, -1))
    u = c.unionByName(d).select("file_path", "idx", "is_cls",
                                F.last("cls", ignorenulls=True).over(w).alias("owner"))
    own = u.where(F.col("is_cls") == 0).select("file_path", "idx", "owner")
    m = funcs.join(own.hint("merge"), ["file_path", "idx"]).where(
        F.col("owner").isNotNull() & (F.col("blk_end_off") <= F.col("owner.cend")) & ~F.col("decorated"))
    return m.select("file_path", F.col("owner.cidx").alias("class_idx"), F.col("owner.cname").alias("class_name"),
                    "idx", "name", F.col("def_line").alias("start_line"), F.col("def_column").alias("start_column"),
                    F.col("blk_end_line").alias("end_line"), F.col("blk_end_column").alias("end_column"),
                    "parameters", "complexity", F.col("def_text").alias("body_text"))


def imports(p: DataFrame, files_masked: DataFrame) -> DataFrame:
    """Dotted names of ``import a.b, c`` (type import) and of ``from m import x``
    (module and each name, type import_from); aliased / relative / star forms
    are not dotted names and are left out."""
    imp = p.where(F.col("stmt").isin("import", "from"))
    w = Window.partitionBy("file_path").orderBy("idx")
    is_word = F.col("kind") == "word"
    prev_text, prev_kind, prev_no = F.lag("text").over(w), F.lag("kind").over(w), F.lag("stmt_no").over(w)
    same_ll = prev_no == F.col("stmt_no")
    cont = same_ll & (((F.col("text") == ".") & (prev_kind == "word")) | (is_word & (prev_text == ".")))
    in_run = is_word | (F.col("text") == ".")
    imp = imp.select("*", in_run.alias("in_run"), F.coalesce(cont, F.lit(False)).alias("cont"),
                     prev_text.alias("before"))
    start_flag = F.when(F.col("in_run") & ~F.col("cont"), 1).otherwise(0)
    imp = imp.select("*", F.sum(start_flag).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                     .alias("run"))
    wr = Window.partitionBy("file_path", "run").orderBy("idx")
    runs = (imp.where(F.col("in_run"))
               .select("*", F.row_number().over(wr).alias("rn"),
                       F.last(F.struct("idx", "char_end", "end_line", "end_bcol", "nxt1"))
                        .over(wr.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
               .where(F.col("rn") == 1))
    is_mod = (F.col("stmt") == "from") & (F.col("before") == "from")
    is_name = F.col("before").isin("import", ",", "(") & ~(F.col("text").isin("import", "from"))
    ok = is_word & ~F.coalesce(F.col("last.nxt1") == "as", F.lit(False)) & (is_mod | is_name)
    cand = runs.where(ok).select(
        "file_path", "idx", "stmt_no", "stmt", is_mod.alias("is_mod"),
        "char_off", F.col("last.char_end").alias("char_end"),
        F.col("line").alias("start_line"), F.col("bcol").alias("start_column"),
        F.col("last.end_line").alias("end_line"), F.col("last.end_bcol").alias("end_column"))
    # from-statements need a module and at least one plain name.
    wl = Window.partitionBy("file_path", "stmt_no")
    cand = cand.withColumn("has_name", F.max((~F.col("is_mod")).cast("int")).over(wl)) \
               .withColumn("has_mod", F.max(F.col("is_mod").cast("int")).over(wl))
    cand = cand.where((F.col("stmt") == "import") | ((F.col("has_name") == 1) & (F.col("has_mod") == 1)))
    fm = files_masked.select("file_path", "content")
    return cand.join(fm, "file_path").select(
        "file_path", "idx", F.expr("substring(content, char_off + 1, char_end - char_off)").alias("text"),
        "start_line", "start_column", "end_line", "end_column",
        F.when(F.col("stmt") == "import", "import").otherwise("import_from").alias("type"))
