"""Languages that are only rows of values."""

from codeloom.operators.analysis import analyse
from codeloom.operators.language_rules import LanguageRule
from tests.conftest import files_df

RUST = LanguageRule("rust", functions=("fn",), types=("impl", "trait", "enum"), structs=("struct",), imports=("use",),
                    decisions=("if", "else", "for", "while", "match"), multiline=True, characters=True)
KOTLIN = LanguageRule("kotlin", functions=("fun",), types=("class", "interface", "object"), imports=("import",), ends="line",
                      decisions=("if", "else", "for", "while", "when", "catch"), strings=('"""', '"'), characters=True)
GDSCRIPT = LanguageRule("gdscript", functions=("func",), types=("class",), imports=("extends",), decisions=("if", "elif", "else", "for", "while"),
                        blocks="indent", ends="line", line_comment="#", block_comment=(), strings=('"""', '"', "'"))

RS = """use std::{fmt,
    io};
use a::b; // tail fn no() {}

/* fn no2() { if } */
fn run<'a, T: Fn(i32) -> i32>(a: &'a str, mut b: Vec<(i32, u8)>) -> T {
    let s = "if { \\" fn x() {
    "; let c = '{'; let d = '\\'';
    if a == s { return b; } else { match c { _ => 1 } }
}
pub struct Point<T> {
    pub x: T, y: Vec<(u8, i32)>,
    // z: u8,
}
struct Unit;
struct Pair(i32, u8);
trait Area { fn area(&self) -> f64; fn twice(&self) -> f64 { while true {} 2.0 } }
impl Point {
    fn new(x: i32, self_: u8) -> Self { fn inner() { } Point {} }
}
"""

KT = '''import a.b.C
import d.e.*   // all

interface I {
    fun a(): Int
    fun b(x: Int = 3, s: String): Int { return if (x > 0) 1 else 2 }
}
class K(val n: Int) : I {
    val t = """fun no() { if"""
    override fun a(): Int = 5
    fun <T> g(x: T): T {
        when (x) { else -> {} }
        return x
    }
}
'''

GD = """extends Node
# func no():
func run(a, b: int = 1, c: String):
\tif a:
\t\tpass
\telif b: pass
class Inner:
\tvar s = "func no2():"
\tfunc m(v):
\t\tfor i in v:
\t\t\tpass
\t\treturn 'if'
func last():
\tpass
"""


def test_languages_by_rows(spark):
    rows = spark.createDataFrame([("rust", ["fn"], ["impl", "trait", "enum"], ["struct"], ["use"], ["if", "else", "for", "while", "match"], True, True)],
                                 "name string, functions array<string>, types array<string>, structs array<string>, imports array<string>, decisions array<string>, multiline boolean, characters boolean")
    assert LanguageRule.rows(rows) == [RUST]
    files = files_df(spark, [("a.rs", "rust", RS), ("a.kt", "kotlin", KT), ("a.gd", "gdscript", GD), ("a.py", "python", "def f():\n    pass\n"), ("a.zig", "zig", "fn x() {}")])
    r = {x.file_path: x for x in analyse(files, rules=[RUST, KOTLIN, GDSCRIPT]).collect()}
    rs = r["a.rs"]
    assert [(f.name, f.complexity) for f in rs.functions] == [("run", 4), ("twice", 2), ("new", 1), ("inner", 1)]
    assert rs.functions[0].parameters == ["a: &'a str", "mut b: Vec<(i32, u8)>"] and rs.functions[0].body_text.startswith("{\n    let s")
    assert rs.functions[0].body_text.endswith("1 } }\n}") and rs.functions[2].parameters == ["x: i32", "self_: u8"]
    assert [(c.name, [m.name for m in c.methods]) for c in rs.classes] == [("Area", ["twice"]), ("Point", ["new"])]
    assert [(s.name, [(f.name, f.type) for f in s.fields]) for s in rs.structs] == [("Point", [("x", "T"), ("y", "Vec<(u8, i32)>")])]
    assert [i.text for i in rs.imports] == ["use std::{fmt, io}", "use a::b"]
    assert {s.name: (s.start_line, s.end_line) for s in rs.function_spans}["run"] == (5, 9)
    assert (rs.metrics.total_lines, rs.metrics.comment_lines, rs.metrics.blank_lines) == (21, 2, 2) and not rs.has_errors
    assert abs(rs.metrics.average_complexity - (4 + 2 + 1 + 1 + 2 + 1) / 6) < 1e-9
    kt = r["a.kt"]
    assert [(f.name, f.complexity, f.parameters) for f in kt.functions] == [("b", 3, ["x: Int", "s: String"])]
    assert [(c.name, [m.name for m in c.methods]) for c in kt.classes] == [("I", ["b"]), ("K", [])]
    assert [i.text for i in kt.imports] == ["import a.b.C", "import d.e.*"]
    gd = r["a.gd"]
    assert [(f.name, f.complexity, f.parameters) for f in gd.functions] == [("run", 3, ["a", "c"]), ("m", 2, ["v"]), ("last", 1, [])]
    assert [(c.name, [m.name for m in c.methods], c.complexity) for c in gd.classes] == [("Inner", ["m"], 2)]
    assert [i.text for i in gd.imports] == ["extends Node"] and gd.metrics.comment_lines == 1
    assert [f.name for f in r["a.py"].functions] == ["f"]
    assert r["a.zig"].has_errors and r["a.zig"].error == "unsupported language: zig"
