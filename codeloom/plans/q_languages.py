"""U1, E3, E9, E11, E22 over further files generated from ``part``, with closed-form oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.analysis import analyse
from ..operators.language_rules import LanguageRule
from ..sources.corpus import ID, K, NL, TAB
from ..sources.tables import read_table
from .registry import register

#: The fourth language: values only.
RUST = ("rust", ["fn"], ["impl", "trait", "enum"], ["struct"], ["use"], ["if", "else", "for", "while", "match"], True, True)
RUST_COLUMNS = ("name string, functions array<string>, types array<string>, structs array<string>, imports array<string>, "
                "decisions array<string>, multiline boolean, characters boolean")

RUST_FILE = f"""concat('use std::fmt;', {NL}, {NL}, '// comment if for', {NL},
 'fn run', {ID}, '(a: i32, b: &str) -> i32 {{', {NL},
 repeat(concat('    if a > 0 {{ return a; }}', {NL}), {K}),
 '    while a < 3 {{ a += 1; }}', {NL}, '    a', {NL}, '}}', {NL}, {NL},
 'struct T', {ID}, ' {{', {NL}, '    value: i32,', {NL}, '    name: String,', {NL}, '}}', {NL}, {NL},
 'impl T', {ID}, ' {{', {NL}, '    fn add(&self, x: i32) -> i32 {{', {NL},
 '        match x {{ 1 => 2, _ => x }}', {NL}, '    }}', {NL}, '}}', {NL})"""

GO_FILE = f"""concat('package main', {NL}, {NL},
 'func Map', {ID}, '[K comparable, V any](m map[K]V, n int) []V {{', {NL},
 repeat(concat({TAB}, 'if n > 0 {{ n-- }}', {NL}), {K}),
 {TAB}, 'return nil', {NL}, '}}', {NL}, {NL},
 'func asm', {ID}, '(a int) int', {NL}, {NL}, 'var v = []int{{1, 2}}', {NL}, {NL},
 'type Pair', {ID}, '[K comparable, V any] struct {{', {NL}, {TAB}, 'Key K', {NL}, {TAB}, 'Val V', {NL}, '}}', {NL})"""

PY_FILE = f"""concat('def run_', {ID}, '(x):', {NL}, '    match x:', {NL},
 repeat(concat('        case 1:', {NL}, '            case = 2', {NL}), {K}),
 '        case _:', {NL}, '            case(x)', {NL}, '    case = 3', {NL}, '    return case', {NL})"""

JAVA_FILE = f"""concat('class A', {ID}, ' {{', {NL}, '    void run', {ID}, '(int a) {{', {NL},
 CASE p_partkey % 4 WHEN 0 THEN '        int x = ;' WHEN 1 THEN '        List<Map<String, ?>> x = new ArrayList<>();'
   WHEN 2 THEN '        Function<Integer, Integer> f = (b) -> b + 1;' ELSE '        foo(a, );' END, {NL},
 '    }}', {NL}, '}}', {NL})"""


def _files(spark, sf_dir, language, content):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    path = f"concat('/more/', CAST(p_partkey % 25 AS STRING), '/f_', {ID}, '.{language}')"
    return part.select(F.expr(path).alias("file_path"), F.lit(language).alias("language"), F.expr(content).alias("content"))


def _src(language):
    return (f"WITH src AS (SELECT concat('/more/', CAST(p_partkey % 25 AS STRING), '/f_', {ID}, '.{language}') AS file_path, "
            f"CAST(p_partkey AS VARCHAR) AS sid, {K} AS k, p_partkey AS id FROM part) ")


@register("fourth_language", _src("rust") + """SELECT file_path,
  'run' || sid || '(a: i32, b: &str):' || (k + 2) || ';add(x: i32):2' AS functions, 'T' || sid || ' add:2' AS classes,
  'T' || sid || ' value i32,name String' AS structs, 'use std::fmt' AS imports, CAST(19 + k AS INTEGER) AS total_lines,
  1 AS comment_lines, 4 AS blank_lines, round((k + 6) / 3.0, 6) AS average_complexity, false AS has_errors FROM src""")
def fourth_language(spark, sf_dir):
    """A language read from a table of rules gives functions, types, structs,
    imports and metrics; without its row its files would be failure records."""
    rules = LanguageRule.rows(spark.createDataFrame([RUST], RUST_COLUMNS))
    a = analyse(_files(spark, sf_dir, "rust", RUST_FILE), rules=rules)
    text = lambda c, f: F.array_join(F.transform(c, f), ";").alias(c)
    return a.select(
        "file_path",
        text("functions", lambda f: F.concat(f["name"], F.lit("("), F.array_join(f["parameters"], ", "), F.lit("):"), f["complexity"].cast("string"))),
        text("classes", lambda c: F.concat(c["name"], F.lit(" "), F.array_join(F.transform(c["methods"], lambda m: m["name"]), ","), F.lit(":"), c["complexity"].cast("string"))),
        text("structs", lambda s: F.concat_ws(" ", s["name"], F.array_join(F.transform(s["fields"], lambda x: F.concat_ws(" ", x["name"], x["type"])), ","))),
        text("imports", lambda i: i["text"]), "metrics.total_lines", "metrics.comment_lines", "metrics.blank_lines",
        F.round("metrics.average_complexity", 6).alias("average_complexity"), "has_errors")


@register("go_generics", _src("go") + """
SELECT file_path, 'function' AS kind, 'Map' || sid AS name, 2 AS start_line, 5 AS start_column, CAST(8 + length(sid) AS INTEGER) AS end_column,
  CAST(k + 1 AS INTEGER) AS complexity, 'm: interface{},n: int' AS detail, CAST(15 + 18 * k AS INTEGER) AS body_len FROM src
UNION ALL SELECT file_path, 'struct', 'Pair' || sid, CAST(10 + k AS INTEGER), 5, CAST(9 + length(sid) AS INTEGER), CAST(NULL AS INTEGER), 'Key,Val',
  CAST(50 + length(sid) AS INTEGER) FROM src""")
def go_generics(spark, sf_dir):
    """Functions and structs with type parameters; a declaration without
    a body is no function, whatever braces follow it."""
    a = analyse(_files(spark, sf_dir, "go", GO_FILE))
    f = a.select("file_path", F.explode("functions").alias("x")).select(
        "file_path", F.lit("function").alias("kind"), "x.name", "x.position.start_line", "x.position.start_column", "x.position.end_column",
        "x.complexity", F.array_join("x.parameters", ",").alias("detail"), F.length("x.body_text").alias("body_len"))
    s = a.select("file_path", F.explode("structs").alias("x")).select(
        "file_path", F.lit("struct").alias("kind"), "x.name", "x.position.start_line", "x.position.start_column", "x.position.end_column",
        F.lit(None).cast("int").alias("complexity"), F.array_join(F.transform("x.fields", lambda y: y["name"]), ",").alias("detail"), F.length("x.body_text").alias("body_len"))
    return f.unionByName(s)


@register("python_soft_case", _src("python") + """
SELECT file_path, 'run_' || sid AS name, CAST(k + 2 AS INTEGER) AS complexity, round(CAST(k + 2 AS DOUBLE), 6) AS average_complexity FROM src""")
def python_soft_case(spark, sf_dir):
    """``case`` counts as a clause of its ``match`` block and nowhere else."""
    a = analyse(_files(spark, sf_dir, "python", PY_FILE))
    return a.select("file_path", F.round("metrics.average_complexity", 6).alias("average_complexity"), F.explode("functions").alias("f")).select(
        "file_path", "f.name", "f.complexity", "average_complexity")


@register("java_syntax_errors", _src("java") + """
SELECT file_path, CASE WHEN id % 4 IN (0, 3) THEN 'regex' ELSE 'tree-sitter' END AS parser_used, 'run' || sid AS functions, 'A' || sid AS classes FROM src""")
def java_syntax_errors(spark, sf_dir):
    """A syntax error between balanced brackets takes the fallback; generics
    and lambdas do not."""
    a = analyse(_files(spark, sf_dir, "java", JAVA_FILE))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)
    return a.select("file_path", "parser_used", names("functions"), names("classes"))
