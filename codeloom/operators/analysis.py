"""One nested analysis record per file.

All pieces come from one tokenisation; every per-file aggregation and join is
keyed by ``file_path`` on data already hash-partitioned by ``file_path``, so the
record assembly adds no exchange beyond the one before tokenising.  Nested
arrays are sorted by source position (``array_sort`` over ``idx``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import materialize
from ..functions.lines import line_metric_cols
from . import extract_go as XG
from . import extract_java as XJ
from . import extract_python as XP
from . import java_regex as JR
from . import language_rules as LR
from .tokens import TOKEN_RE, token_table


def _pos(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).cast("int").alias(c) for c in
                      ("start_line", "start_column", "end_line", "end_column")])


def _func(params=True) -> Column:
    return F.struct(F.col("name"), _pos().alias("position"),
                    (F.col("parameters") if params else F.array().cast("array<string>")).alias("parameters"),
                    F.col("complexity").cast("int").alias("complexity"), F.col("body_text"))


def _sorted(col: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(col)), lambda x: x["v"])


def _part(df: DataFrame, **values: Column) -> DataFrame:
    """Rows of one kind for the one aggregation per file; what the kind lacks is null."""
    kinds = {"function": schemas.FUNCTION, "span": schemas.SPAN, "class": CLASS, "methods": METHODS, "struct": schemas.STRUCT,
             "import": schemas.IMPORT, "complexity": T.IntegerType()}
    return df.select("file_path", "idx", *[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


#: A class without its methods, and the methods of one class.
CLASS = T.StructType([T.StructField("idx", T.IntegerType()), *[f for f in schemas.CLASS.fields if f.name != "methods"]])
METHODS = T.StructType([T.StructField("class_idx", T.IntegerType()), T.StructField("ms", T.ArrayType(schemas.FUNCTION))])


def _assemble(parts: list[DataFrame]) -> DataFrame:
    """One row per file with its lists in source order: one exchange and one
    aggregation for all kinds of rows, which are collected as one list (a list for
    each kind would be written and read for each file, though most are empty)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    kinds = ("function", "span", "class", "struct", "import", "methods")
    of = lambda c: F.filter("all", lambda x: x[c].isNotNull())
    listed = lambda c: F.transform(F.array_sort(F.transform(of(c), lambda x: F.struct(x["idx"].alias("k"), x[c].alias("v")))), lambda x: x["v"])
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in kinds])
    a = (u.groupBy("file_path").agg(F.collect_list(F.when(some, F.struct("idx", *kinds))).alias("all"), F.avg("complexity").alias("avg_c"))
          .select("file_path", listed("function").alias("functions"), listed("span").alias("function_spans"), listed("class").alias("classes"), listed("struct").alias("structs"),
                  listed("import").alias("imports"), F.map_from_entries(F.transform(of("methods"), lambda x: x["methods"])).alias("mm"), "avg_c"))
    nested = F.transform("classes", lambda c: F.struct(
        c["name"].alias("name"), c["position"].alias("position"),
        F.coalesce(F.element_at(F.col("mm"), c["idx"]), F.array().cast(T.ArrayType(schemas.FUNCTION))).alias("methods"),
        c["complexity"].alias("complexity"), c["body_text"].alias("body_text")))
    return a.withColumn("classes", nested).drop("mm")


def analyse(files: DataFrame, num_partitions: int | None = None, rules=()) -> DataFrame:
    """files(file_path, language, content) → analysis records (schema ANALYSIS)
    plus ``function_spans``: (name, first line, last line) of every function's
    whole definition, for locating code by line (L6).  ``rules`` (LanguageRule rows)
    add languages to the built-in ones (U1)."""
    known = F.coalesce(F.col("language").isin(*TOKEN_RE, *(r.name for r in rules)) & F.col("content").isNotNull(), F.lit(False))
    failed = failure_records(files.where(~known))
    s, fm = token_table(files.where(known), num_partitions, rules)
    n = num_partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    p = XP.prepare(s)
    py_f, py_c = XP.split_definitions(materialize(XP.definitions(p, fm), "py_defs", "file_path", n))
    py_m = XP.class_methods(py_f, py_c)
    py_i = XP.imports(p, fm)

    g = XG.prepare(s)
    go_f, go_s, go_i, go_t = XG.functions(g, fm), XG.structs(g, fm), XG.imports(g), XG.type_declarations(g)

    j = XJ.prepare(s)
    ja_m = materialize(XJ.methods(j, fm), "java_methods", "file_path", n)
    ja_c = XJ.classes(j, fm)
    ja_cm = XJ.class_methods(ja_m, ja_c)
    ja_i = XJ.imports(j, fm)

    added = [LR.extract(s, fm, r) for r in rules]

    def plus(base: DataFrame, part: str, *cols) -> DataFrame:
        for a in added:
            base = base.unionByName(a[part].select(*cols))
        return base

    def span(df: DataFrame, first: str, last: str) -> DataFrame:
        f = F.struct("name", F.col(first).alias("start_line"), F.col(last).alias("end_line"))
        return _part(df, function=_func(), span=f, complexity=F.col("complexity"))

    one_class = F.struct("idx", "name", _pos().alias("position"), F.col("complexity").cast("int").alias("complexity"), "body_text")
    cls_cols = ["file_path", "idx", "name", "start_line", "start_column", "end_line", "end_column",
                "complexity", "body_text"]
    classes = plus(py_c.select(cls_cols).unionByName(ja_c.select(cls_cols)), "classes", *cls_cols)
    methods = (plus(py_m.unionByName(ja_cm), "methods", *py_m.columns).groupBy("file_path", "class_idx")
               .agg(_sorted(F.struct(F.col("idx").alias("k"), _func().alias("v"))).alias("ms")).withColumn("idx", F.col("class_idx")))
    structs = plus(go_s, "structs", *go_s.columns)
    imp = lambda d: d.select("file_path", "idx", F.struct("text", _pos().alias("position"), "type").alias("v"))
    imports = plus(imp(py_i).unionByName(imp(go_i)).unionByName(imp(ja_i)), "imports", "file_path", "idx", F.struct("text", _pos().alias("position"), "type").alias("v"))
    per_file = _assemble([
        span(py_f, "def_line", "blk_end_line"), span(go_f, "span_start_line", "span_end_line"), span(ja_m, "decl_line", "close_line"),
        *(span(a["functions"], "decl_line", "close_line") for a in added),
        _part(classes, **{"class": one_class, "complexity": F.col("complexity")}),
        _part(methods, methods=F.struct("class_idx", "ms")),
        _part(structs, struct=F.struct("name", _pos().alias("position"), "fields", "body_text")),
        _part(imports, **{"import": F.col("v")}),
        # they count in the average, though no list has them
        _part(go_t, complexity=F.col("complexity")), _part(XJ.bodiless_methods(j), complexity=F.col("complexity"))])

    base = fm.select("file_path", "language", "content", F.col("file_balanced").alias("balanced"))
    m = line_metric_cols(F.col("content"), F.col("language"), {r.name: LR.comment_lines(r) for r in rules})
    rec = base.join(per_file.hint("merge"), "file_path", "left")
    empty = lambda t: F.array().cast(T.ArrayType(t))
    structural = rec.where((F.col("language") != "java") | F.coalesce("balanced", F.lit(True))).select(
        "file_path", "language",
        F.coalesce("functions", empty(schemas.FUNCTION)).alias("functions"),
        F.coalesce("classes", empty(schemas.CLASS)).alias("classes"),
        F.coalesce("structs", empty(schemas.STRUCT)).alias("structs"),
        F.coalesce("imports", empty(schemas.IMPORT)).alias("imports"),
        F.struct(m["total_lines"].alias("total_lines"), m["code_lines"].alias("code_lines"),
                 m["comment_lines"].alias("comment_lines"), m["blank_lines"].alias("blank_lines"),
                 F.coalesce("avg_c", F.lit(0.0)).cast("double").alias("average_complexity")).alias("metrics"),
        F.lit(False).alias("has_errors"),
        F.when(F.col("language") == "java", "tree-sitter").alias("parser_used"),
        F.lit(None).cast("string").alias("error"),
        F.coalesce("function_spans", empty(schemas.SPAN)).alias("function_spans"))
    fallback = regex_records(base.where((F.col("language") == "java") & ~F.coalesce("balanced", F.lit(True)))
                             .select("file_path", "language", "content"))
    return structural.unionByName(fallback).unionByName(failed)


def failure_records(files: DataFrame) -> DataFrame:
    """The empty record of a file that cannot be analysed, with the reason."""
    empty = lambda t: F.array().cast(T.ArrayType(t))
    zero = [F.lit(0).alias(c) for c in ("total_lines", "code_lines", "comment_lines", "blank_lines")]
    why = (F.when(F.col("language").isNull(), "unknown language").when(F.col("content").isNull(), "no content")
            .otherwise(F.concat(F.lit("unsupported language: "), "language")))
    return files.select(
        "file_path", "language", empty(schemas.FUNCTION).alias("functions"), empty(schemas.CLASS).alias("classes"),
        empty(schemas.STRUCT).alias("structs"), empty(schemas.IMPORT).alias("imports"),
        F.struct(*zero, F.lit(0.0).alias("average_complexity")).alias("metrics"), F.lit(True).alias("has_errors"),
        F.lit(None).cast("string").alias("parser_used"), why.alias("error"), empty(schemas.SPAN).alias("function_spans"))


def regex_records(files: DataFrame) -> DataFrame:
    """The Java fallback record for files the structural path rejects."""
    fm = files.select("file_path", "content")
    mk = lambda d: d.select("file_path", F.struct(
        F.col("start_line").alias("k1"), F.col("start_column").alias("k2"),
        F.struct("name", _pos().alias("position"), F.array().cast("array<string>").alias("parameters"),
                 F.lit(1).alias("complexity"), F.lit("").alias("body_text")).alias("v")).alias("e"))
    srt = lambda name: F.transform(F.array_sort(F.collect_list("e")), lambda x: x["v"]).alias(name)
    fn = mk(JR.methods(fm)).groupBy("file_path").agg(srt("functions"))
    cl = (JR.classes(fm).select("file_path", F.struct(
        F.col("start_line").alias("k1"), F.col("start_column").alias("k2"),
        F.struct("name", _pos().alias("position"), F.array().cast(T.ArrayType(schemas.FUNCTION)).alias("methods"),
                 F.lit(1).alias("complexity"), F.lit("").alias("body_text")).alias("v")).alias("e"))
          .groupBy("file_path").agg(srt("classes")))
    im = (JR.imports(fm).select("file_path", F.struct(
        F.col("start_line").alias("k1"), F.col("start_column").alias("k2"),
        F.struct("text", _pos().alias("position"), "type").alias("v")).alias("e"))
          .groupBy("file_path").agg(srt("imports")))
    mt = JR.metrics(fm)
    empty = lambda t: F.array().cast(T.ArrayType(t))
    r = files.select("file_path", "language")
    for part in (fn, cl, im, mt):
        r = r.join(part.hint("merge"), "file_path", "left")
    return r.select(
        "file_path", "language",
        F.coalesce("functions", empty(schemas.FUNCTION)).alias("functions"),
        F.coalesce("classes", empty(schemas.CLASS)).alias("classes"),
        empty(schemas.STRUCT).alias("structs"),
        F.coalesce("imports", empty(schemas.IMPORT)).alias("imports"),
        F.struct("total_lines", "code_lines", "comment_lines", "blank_lines",
                 F.col("average_complexity").cast("double").alias("average_complexity")).alias("metrics"),
        F.lit(False).alias("has_errors"), F.lit("regex").alias("parser_used"),
        F.lit(None).cast("string").alias("error"), empty(schemas.SPAN).alias("function_spans"))


def with_flat_columns(analysis: DataFrame) -> DataFrame:
    """The table as it is stored: counts, function names and places as flat columns."""
    return analysis.withColumns({
        **{f"n_{c}": F.size(c) for c in ("functions", "classes", "structs", "imports")},
        "function_names": F.transform("functions", lambda f: f["name"]),
        "function_heads": F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["position"].alias("position")))})


def summary(analysis: DataFrame, by_language: bool = False) -> DataFrame:
    """A1: files, functions, classes, imports (partial aggregation per task);
    a stored table's flat counts are read instead of the nested columns."""
    def n(column):
        flat = f"n_{column}"
        return F.col(flat) if flat in analysis.columns else F.size(column)
    aggs = [F.count(F.lit(1)).alias("total_files"),
            *[F.sum(n(c)).alias(f"total_{c}") for c in ("functions", "classes", "imports")]]
    return analysis.groupBy("language").agg(*aggs) if by_language else analysis.agg(*aggs)
