"""E2–E22 extraction plans over the generated corpus, with closed-form oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract_python as XP
from ..operators.tokens import token_table
from ..session import materialize, scratch_path
from ..sources.corpus import code_files, duck_code_cte
from .registry import register


def _tokens(spark, sf_dir, language=None):
    files = code_files(spark, sf_dir).select("file_path", "language", "content")
    if language:
        files = files.where(F.col("language") == language)
    return token_table(files)


def python_tables(spark, sf_dir):
    s, fm = _tokens(spark, sf_dir, "python")
    p = XP.prepare(s)
    # read several times for the classes and their methods
    funcs, classes = XP.split_definitions(materialize(XP.definitions(p, fm), "py_defs", "file_path"))
    return funcs, classes, XP.class_methods(funcs, classes), XP.imports(p, fm)


def _W(lang_mod):
    return f"WITH {duck_code_cte()}, src AS (SELECT *, CAST(id AS VARCHAR) AS sid FROM code WHERE id % 3 = {lang_mod}) "


I = "CAST({} AS INTEGER)"


@register("py_functions", _W(0) + """
SELECT file_path, 'run_' || sid AS name, 4 AS start_line, 4 AS start_column, 4 AS end_line,
  CAST(4 + length('run_' || sid) AS INTEGER) AS end_column, k + 2 AS complexity, 'a' AS parameters,
  CAST(43 + 28 * k AS INTEGER) AS body_len FROM src
UNION ALL
SELECT file_path, 'm_' || sid, 9 + 2 * k, 8, 9 + 2 * k, CAST(8 + length('m_' || sid) AS INTEGER), 2, 'self,v',
  43 FROM src""")
def py_functions(spark, sf_dir):
    """E4 (+E3 complexity, E2 positions): every ``def`` with name position."""
    f = python_tables(spark, sf_dir)[0]
    return f.select("file_path", "name", "start_line", "start_column", "end_line", "end_column", "complexity",
                    F.array_join("parameters", ",").alias("parameters"), F.length("body_text").alias("body_len"))


@register("py_parameters", _W(0) + """
SELECT file_path, 'run_' || sid AS function, 0 AS pos, 'a' AS parameter FROM src
UNION ALL SELECT file_path, 'm_' || sid, 0, 'self' FROM src
UNION ALL SELECT file_path, 'm_' || sid, 1, 'v' FROM src""")
def py_parameters(spark, sf_dir):
    """E5: bare and annotated names only (defaults, *args, **kwargs dropped)."""
    f = python_tables(spark, sf_dir)[0]
    return f.select("file_path", F.col("name").alias("function"), F.posexplode("parameters").alias("pos", "parameter"))


@register("py_classes", _W(0) + """
SELECT file_path, 'K' || sid AS name, 8 + 2 * k AS start_line, 6 AS start_column, 8 + 2 * k AS end_line,
  CAST(6 + length('K' || sid) AS INTEGER) AS end_column, 2 AS complexity, 'm_' || sid AS methods,
  CAST(68 + length(sid) AS INTEGER) AS body_len FROM src""")
def py_classes(spark, sf_dir):
    """Classes with whole-class complexity and their direct methods."""
    _, c, m, _ = python_tables(spark, sf_dir)
    ms = m.groupBy("file_path", "class_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]), ",")
        .alias("methods"))
    j = c.join(ms, (c.file_path == ms.file_path) & (c.idx == ms.class_idx), "left").drop(ms.file_path)
    return j.select("file_path", "name", "start_line", "start_column", "end_line", "end_column", "complexity",
                    F.coalesce("methods", F.lit("")).alias("methods"), F.length("body_text").alias("body_len"))


@register("py_methods", _W(0) + """
SELECT file_path, 'K' || sid AS class_name, 'm_' || sid AS name, 9 + 2 * k AS start_line, 4 AS start_column,
  12 + 2 * k AS end_line, 16 AS end_column, 2 AS complexity, 'self,v' AS parameters,
  CAST(68 + length(sid) AS INTEGER) AS body_len FROM src""")
def py_methods(spark, sf_dir):
    """Direct, undecorated defs of a class; whole-definition position/body."""
    m = python_tables(spark, sf_dir)[2]
    return m.select("file_path", "class_name", "name", "start_line", "start_column", "end_line", "end_column",
                    "complexity", F.array_join("parameters", ",").alias("parameters"),
                    F.length("body_text").alias("body_len"))


@register("py_imports", _W(0) + """
SELECT file_path, 'os' AS text, 0 AS start_line, 7 AS start_column, 0 AS end_line, 9 AS end_column,
  'import' AS type FROM src
UNION ALL SELECT file_path, 'typing', 1, 5, 1, 11, 'import_from' FROM src
UNION ALL SELECT file_path, 'List', 1, 19, 1, 23, 'import_from' FROM src""")
def py_imports(spark, sf_dir):
    """One row per dotted name; plain imports vs from-imports."""
    i = python_tables(spark, sf_dir)[3]
    return i.select("file_path", "text", "start_line", "start_column", "end_line", "end_column", "type")


from ..operators import extract_go as XG  # noqa: E402
from ..operators import extract_java as XJ  # noqa: E402


def go_tables(spark, sf_dir):
    s, fm = _tokens(spark, sf_dir, "go")
    g = XG.prepare(s)
    return XG.functions(g, fm), XG.structs(g, fm), XG.imports(g), XG.type_declarations(g)


def java_tables(spark, sf_dir):
    s, fm = _tokens(spark, sf_dir, "java")
    j = XJ.prepare(s)
    m, c = XJ.methods(j, fm), XJ.classes(j, fm)
    return m, c, XJ.class_methods(m, c), XJ.imports(j, fm)


@register("go_functions", _W(1) + """
SELECT file_path, 'run' || sid AS name, 5 AS start_line, 5 AS start_column, 5 AS end_line,
  CAST(5 + length('run' || sid) AS INTEGER) AS end_column, k + 2 AS complexity,
  'a: int,m: interface{}' AS parameters, CAST(32 + 18 * k AS INTEGER) AS body_len FROM src""")
def go_functions(spark, sf_dir):
    """``func name(`` without receiver; E10 parameters rendered ``name: type``."""
    f = go_tables(spark, sf_dir)[0]
    return f.select("file_path", "name", "start_line", "start_column", "end_line", "end_column", "complexity",
                    F.array_join("parameters", ",").alias("parameters"), F.length("body_text").alias("body_len"))


@register("go_parameters", _W(1) + """
SELECT file_path, 'run' || sid AS function, 0 AS pos, 'a: int' AS parameter FROM src
UNION ALL SELECT file_path, 'run' || sid, 1, 'm: interface{}' FROM src""")
def go_parameters(spark, sf_dir):
    """identifier/pointer/array/slice types kept, others ``interface{}``."""
    f = go_tables(spark, sf_dir)[0]
    return f.select("file_path", F.col("name").alias("function"), F.posexplode("parameters").alias("pos", "parameter"))


@register("go_structs", _W(1) + """
SELECT file_path, 'T' || sid AS name, 10 + k AS start_line, 5 AS start_column, 10 + k AS end_line,
  CAST(5 + length('T' || sid) AS INTEGER) AS end_column, 2 AS n_fields,
  CAST(50 + length('T' || sid) AS INTEGER) AS body_len FROM src""")
def go_structs(spark, sf_dir):
    """Struct type specs with name position and type-spec text."""
    s = go_tables(spark, sf_dir)[1]
    return s.select("file_path", "name", "start_line", "start_column", "end_line", "end_column",
                    F.size("fields").alias("n_fields"), F.length("body_text").alias("body_len"))


@register("go_struct_fields", _W(1) + """
SELECT file_path, 'T' || sid AS struct_name, 0 AS pos, 'Value' AS name, 'int' AS type, NULL AS tag FROM src
UNION ALL SELECT file_path, 'T' || sid, 1, 'Name', '*string', '`json:"name"`' FROM src""")
def go_struct_fields(spark, sf_dir):
    """(name, type, raw-string tag) per field."""
    s = go_tables(spark, sf_dir)[1]
    return s.select("file_path", F.col("name").alias("struct_name"), F.posexplode("fields").alias("pos", "f")) \
            .select("file_path", "struct_name", "pos", "f.name", "f.type", "f.tag")


@register("go_imports", _W(1) + """
SELECT file_path, 'import "fmt"' AS text, 2 AS start_line, 7 AS start_column, 2 AS end_line, 12 AS end_column,
  'regular' AS type FROM src""")
def go_imports(spark, sf_dir):
    """Single and grouped imports, named when aliased."""
    i = go_tables(spark, sf_dir)[2]
    return i.select("file_path", "text", "start_line", "start_column", "end_line", "end_column", "type")


@register("java_methods", _W(2) + """
SELECT file_path, 'run' || sid AS name, 9 AS start_line, 15 AS start_column, 9 AS end_line,
  CAST(15 + length('run' || sid) AS INTEGER) AS end_column, k + 2 AS complexity,
  'a: Object,b: List<String>' AS parameters, CAST(61 + 28 * k AS INTEGER) AS body_len FROM src""")
def java_methods(spark, sf_dir):
    """Method declarations with a body (no constructors, no abstract)."""
    m = java_tables(spark, sf_dir)[0]
    return m.select("file_path", "name", "start_line", "start_column", "end_line", "end_column", "complexity",
                    F.array_join("parameters", ",").alias("parameters"), F.length("body_text").alias("body_len"))


@register("java_parameters", _W(2) + """
SELECT file_path, 'run' || sid AS function, 0 AS pos, 'a: Object' AS parameter FROM src
UNION ALL SELECT file_path, 'run' || sid, 1, 'b: List<String>' FROM src""")
def java_parameters(spark, sf_dir):
    """identifier/array/generic types kept, primitives and scoped as Object."""
    m = java_tables(spark, sf_dir)[0]
    return m.select("file_path", F.col("name").alias("function"), F.posexplode("parameters").alias("pos", "parameter"))


@register("java_classes", _W(2) + """
SELECT file_path, 'C' || sid AS name, 7 AS start_line, 13 AS start_column, 7 AS end_line,
  CAST(13 + length('C' || sid) AS INTEGER) AS end_column, k + 2 AS complexity, 'run' || sid AS methods,
  CAST(125 + length(sid) + 28 * k AS INTEGER) AS body_len FROM src""")
def java_classes(spark, sf_dir):
    """Classes with whole-class complexity and direct methods."""
    _, c, cm, _ = java_tables(spark, sf_dir)
    ms = cm.groupBy("file_path", "class_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]), ",")
        .alias("methods"))
    j = c.join(ms, (c.file_path == ms.file_path) & (c.idx == ms.class_idx), "left").drop(ms.file_path)
    return j.select("file_path", "name", "start_line", "start_column", "end_line", "end_column", "complexity",
                    F.coalesce("methods", F.lit("")).alias("methods"), F.length("body_text").alias("body_len"))


@register("java_class_methods", _W(2) + """
SELECT file_path, 'C' || sid AS class_name, 'run' || sid AS name, 9 AS start_line, 4 AS start_column,
  12 + k AS end_line, 5 AS end_column, k + 2 AS complexity, 'a: Object,b: List<String>' AS parameters,
  CAST(99 + length(sid) + 28 * k AS INTEGER) AS body_len FROM src""")
def java_class_methods(spark, sf_dir):
    """Direct methods; position and text of the whole declaration."""
    cm = java_tables(spark, sf_dir)[2]
    return cm.select("file_path", "class_name", "name", "start_line", "start_column", "end_line", "end_column",
                     "complexity", F.array_join("parameters", ",").alias("parameters"),
                     F.length("body_text").alias("body_len"))


@register("java_imports", _W(2) + """
SELECT file_path, 'import java.util.List;' AS text, 1 AS start_line, 7 AS start_column, 1 AS end_line,
  21 AS end_column, 'regular' AS type FROM src
UNION ALL SELECT file_path, 'import java.lang.Math.abs;', 2, 14, 2, 32, 'regular' FROM src""")
def java_imports(spark, sf_dir):
    """``import [static] a.b.c;`` rebuilt as ``import a.b.c;``, type regular."""
    i = java_tables(spark, sf_dir)[3]
    return i.select("file_path", "text", "start_line", "start_column", "end_line", "end_column", "type")


from ..operators import analysis as AN  # noqa: E402
from ..operators import java_regex as JR  # noqa: E402


def code_analysis(spark, sf_dir):
    """The analysis table of the generated corpus (+ created_at for searches)."""
    files = code_files(spark, sf_dir)
    rec = AN.analyse(files.select("file_path", "language", "content"))
    # a row for each file, however little room the table it is rendered from takes: never broadcast
    return rec.join(files.select("file_path", "created_at").hint("merge"), "file_path")


def build_analysis_table(spark, sf_dir):
    """Analyse the corpus and write the table that searches read; its path.

    Rows are ranged by language and path, so a point lookup by path skips all
    files but one and a language filter most of them; a large language spreads
    over many files.  Counts and names are flat columns beside the nested ones:
    listings and summaries read no body text."""
    path = scratch_path(spark, "analysis_current")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written before it is ranged: the bounds come from a sample of the keys, which
    # would assemble all records a first time.
    (materialize(AN.with_flat_columns(code_analysis(spark, sf_dir)), "analysis_records").repartitionByRange(n, "language", "file_path")
        .sortWithinPartitions("language", "file_path").write.mode("overwrite").parquet(path))
    return path


_BUILT: dict = {}


def analysis_table(spark, sf_dir):
    """The stored table of this corpus, built when there is none for these very
    rows yet (their checksum tells, so changed data are analysed anew)."""
    rows = code_files(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "language", "content", "created_at").cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, sf_dir, *rows)
    if key not in _BUILT:
        _BUILT[key] = build_analysis_table(spark, sf_dir)
    return spark.read.parquet(_BUILT[key])


AVG = ("CASE id % 3 WHEN 0 THEN (k + 6) / 3.0 WHEN 1 THEN (k + 3) / 2.0 ELSE CAST(k + 2 AS DOUBLE) END")
NFUN = "CASE id % 3 WHEN 0 THEN 2 ELSE 1 END"
NCLS = "CASE id % 3 WHEN 1 THEN 0 ELSE 1 END"
NIMP = "CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END"
FNAMES = "CASE id % 3 WHEN 0 THEN 'run_' || sid || ',m_' || sid ELSE 'run' || sid END"
CNAMES = "CASE id % 3 WHEN 0 THEN 'K' || sid WHEN 1 THEN '' ELSE 'C' || sid END"
WALL = f"WITH {duck_code_cte()}, src AS (SELECT *, CAST(id AS VARCHAR) AS sid FROM code) "


@register("analysis_record", WALL + f"""
SELECT file_path, language, {NFUN} AS n_functions, {NCLS} AS n_classes,
  CASE id % 3 WHEN 1 THEN 1 ELSE 0 END AS n_structs, {NIMP} AS n_imports,
  {FNAMES} AS function_names, {CNAMES} AS class_names,
  CASE id % 3 WHEN 2 THEN 'tree-sitter' END AS parser_used, false AS has_errors FROM src""")
def analysis_record(spark, sf_dir):
    """The nested per-file record, checked by array sizes and names (the
    record is computed once per dataset and stored; later plans read it)."""
    a = analysis_table(spark, sf_dir)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return a.select("file_path", "language", F.size("functions").alias("n_functions"),
                    F.size("classes").alias("n_classes"), F.size("structs").alias("n_structs"),
                    F.size("imports").alias("n_imports"), names("functions").alias("function_names"),
                    names("classes").alias("class_names"), "parser_used", "has_errors")


@register("avg_complexity", WALL + f"SELECT file_path, round({AVG}, 6) AS average_complexity FROM src")
def avg_complexity(spark, sf_dir):
    """M6: mean complexity over function and class (Go: type) definitions."""
    a = analysis_table(spark, sf_dir)
    return a.select("file_path", F.round("metrics.average_complexity", 6).alias("average_complexity"))


@register("repo_summary", WALL + f"""
SELECT count(*) AS total_files, CAST(sum({NFUN}) AS BIGINT) AS total_functions, CAST(sum({NCLS}) AS BIGINT) AS total_classes,
  CAST(sum({NIMP}) AS BIGINT) AS total_imports FROM src""")
def repo_summary(spark, sf_dir):
    """A1: repository summary counters."""
    return AN.summary(analysis_table(spark, sf_dir))


@register("repo_summary_by_language", WALL + f"""
SELECT language, count(*) AS total_files, CAST(sum({NFUN}) AS BIGINT) AS total_functions, CAST(sum({NCLS}) AS BIGINT) AS total_classes,
  CAST(sum({NIMP}) AS BIGINT) AS total_imports FROM src GROUP BY language""")
def repo_summary_by_language(spark, sf_dir):
    """A1 per language (the flagship query of ``entry``)."""
    return AN.summary(analysis_table(spark, sf_dir), by_language=True)


@register("function_positions", WALL + """
SELECT file_path, name, start_line, start_column, end_line, end_column FROM (
  SELECT file_path, 'run_' || sid AS name, 4 AS start_line, 4 AS start_column, 4 AS end_line,
    CAST(4 + length('run_' || sid) AS INTEGER) AS end_column FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'm_' || sid, 9 + 2 * k, 8, 9 + 2 * k, CAST(8 + length('m_' || sid) AS INTEGER)
    FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'run' || sid, 5, 5, 5, CAST(5 + length('run' || sid) AS INTEGER) FROM src WHERE id % 3 = 1
  UNION ALL SELECT file_path, 'run' || sid, 9, 15, 9, CAST(15 + length('run' || sid) AS INTEGER) FROM src
    WHERE id % 3 = 2) t""")
def function_positions(spark, sf_dir):
    """0-based line / byte-column spans of every function name."""
    a = analysis_table(spark, sf_dir)
    f = a.select("file_path", F.explode("functions").alias("f"))
    return f.select("file_path", "f.name", "f.position.*")


@register("function_complexity", WALL + """
SELECT file_path, language, name, complexity FROM (
  SELECT file_path, language, 'run_' || sid AS name, k + 2 AS complexity FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, language, 'm_' || sid, 2 FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, language, 'run' || sid, k + 2 FROM src WHERE id % 3 <> 0) t""")
def function_complexity(spark, sf_dir):
    """1 + decision keywords in the span (strings and comments excluded)."""
    a = analysis_table(spark, sf_dir)
    return a.select("file_path", "language", F.explode("functions").alias("f")) \
            .select("file_path", "language", "f.name", "f.complexity")


def _java_files(spark, sf_dir):
    return code_files(spark, sf_dir).where(F.col("language") == "java").select("file_path", "language", "content")


@register("java_methods_regex", _W(2) + """
SELECT file_path, 'run' || sid AS name, 9 AS start_line, 0 AS start_column, 9 AS end_line,
  CAST(43 + length(sid) AS INTEGER) AS end_column, 1 AS complexity FROM src""")
def java_methods_regex(spark, sf_dir):
    """The line-pattern method finder (fallback path) over every Java file."""
    return JR.methods(_java_files(spark, sf_dir))


@register("java_classes_regex", _W(2) + """
SELECT file_path, 'C' || sid AS name, 7 AS start_line, 0 AS start_column, 7 AS end_line,
  CAST(16 + length(sid) AS INTEGER) AS end_column, 1 AS complexity FROM src""")
def java_classes_regex(spark, sf_dir):
    """The line-pattern class finder."""
    return JR.classes(_java_files(spark, sf_dir))


@register("java_imports_regex", _W(2) + """
SELECT file_path, 'import java.util.List;' AS text, 1 AS start_line, 0 AS start_column, 1 AS end_line,
  22 AS end_column, 'regular' AS type FROM src
UNION ALL SELECT file_path, 'import static java.lang.Math.abs;', 2, 0, 2, 33, 'static' FROM src""")
def java_imports_regex(spark, sf_dir):
    """Raw import lines, static vs regular."""
    return JR.imports(_java_files(spark, sf_dir))


@register("java_metrics_regex", _W(2) + """
SELECT file_path, CAST(15 + k AS INTEGER) AS total_lines, CAST(9 + k AS INTEGER) AS code_lines,
  4 AS comment_lines, 2 AS blank_lines, CAST(1.0 AS DOUBLE) AS average_complexity FROM src""")
def java_metrics_regex(spark, sf_dir):
    """M5: line counts with the block-comment state machine."""
    return JR.metrics(_java_files(spark, sf_dir))


@register("java_fallback", _W(2) + """
SELECT file_path, 'tree-sitter' AS parser_used, 1 AS n_functions, 1 AS n_classes, 2 AS n_imports,
  2 AS comment_lines, CAST(11 + k AS INTEGER) AS code_lines, round(CAST(k + 2 AS DOUBLE), 6) AS average_complexity
FROM src
UNION ALL SELECT file_path || '.broken', 'regex', 1, 1, 2, 4, CAST(8 + k AS INTEGER), 1.0 FROM src""")
def java_fallback(spark, sf_dir):
    """Balanced files take the structural path; a copy with its final
    closing brace removed is routed to the line-pattern fallback."""
    jf = _java_files(spark, sf_dir)
    broken = jf.select(F.concat("file_path", F.lit(".broken")).alias("file_path"), "language",
                       F.regexp_replace("content", "\\}\\n$", "").alias("content"))
    a = AN.analyse(jf.unionByName(broken))
    return a.select("file_path", "parser_used", F.size("functions").alias("n_functions"),
                    F.size("classes").alias("n_classes"), F.size("imports").alias("n_imports"),
                    "metrics.comment_lines", "metrics.code_lines",
                    F.round("metrics.average_complexity", 6).alias("average_complexity"))


@register("analysis_errors", f"""WITH {duck_code_cte()}
SELECT file_path, CASE id % 10 WHEN 0 THEN 'rust' WHEN 1 THEN NULL ELSE language END AS language, id % 10 < 3 AS has_errors,
  CASE id % 10 WHEN 0 THEN 'unsupported language: rust' WHEN 1 THEN 'unknown language' WHEN 2 THEN 'no content' END AS error,
  CASE WHEN id % 10 < 3 THEN 0 ELSE {NIMP} END AS n_imports FROM code""")
def analysis_errors(spark, sf_dir):
    """Files that cannot be analysed keep an empty record with the reason."""
    from ..operators.analysis import analyse
    code = code_files(spark, sf_dir)
    odd = code.select("file_path", F.when(F.col("id") % 10 == 0, "rust").when(F.col("id") % 10 != 1, F.col("language")).alias("language"),
                      F.when(F.col("id") % 10 != 2, F.col("content")).alias("content"))
    return analyse(odd).select("file_path", "language", "has_errors", "error", F.size("imports").alias("n_imports"))
