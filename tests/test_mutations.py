"""FIXTURES §2 mutations: edges of the extraction semantics."""

import re

from pyspark.sql import functions as F

from codeloom.operators.analysis import analyse
from tests.conftest import files_df

PY = (
    "import a.b as c\n"
    "from . import rel\n"
    "from x import y as z\n"
    "from m import (p,\n    q)\n"
    "class K:\n"
    "    @property\n"
    "    def deco(self):\n"
    "        return 1\n"
    "    def outer(self, v):\n"
    "        def inner(w):\n"
    "            return w if w else v\n"
    "        return inner\n"
    "x = 'def fake(): pass if'"
)

GO = (
    "package main\n\n"
    "import (\n\tf \"fmt\"\n\t\"os\"\n\t_ \"embed\"\n)\n\n"
    "func pair(a, b int, s []string, p *T, q pkg.Type) (int, error) {\n"
    "\tswitch a {\n\tcase 1:\n\t\treturn 1, nil\n\tcase 2:\n\t\treturn 2, nil\n\t}\n"
    "\treturn 0, nil\n}\n\n"
    "func (r *R) M() {}\n"
)

JAVA = (
    "import static a.b.C.d;\n"
    "import java.util.*;\n"
    "public abstract class Foo extends Bar {\n"
    "    public Foo(int x) { super(x); }\n"
    "    abstract void todo();\n"
    "    @Override\n"
    "    public String toString() { return \"if\"; }\n"
    "    private static <T> java.util.List<T> gen(final T[] arr, String... rest) throws E {\n"
    "        try { } catch (E e) { } finally { }\n"
    "        do { } while (false);\n"
    "        return null;\n"
    "    }\n"
    "}\n"
)


def _rec(spark, rows):
    return {r.file_path: r for r in analyse(files_df(spark, rows)).collect()}


def test_python_mutations(spark):
    r = _rec(spark, [("m.py", "python", PY), ("crlf.py", "python", "def f(a):\r\n    if a:\r\n        return 1\r\n"),
                     ("nonl.py", "python", "def g():\n    return 2"), ("empty.py", "python", "")])
    m = r["m.py"]
    assert [(i.text, i.type) for i in m.imports] == [("m", "import_from"), ("p", "import_from"), ("q", "import_from")]
    assert [f.name for f in m.functions] == ["deco", "outer", "inner"]
    assert [[x.name for x in c.methods] for c in m.classes] == [["outer"]]
    assert {f.name: f.complexity for f in m.functions} == {"deco": 1, "outer": 3, "inner": 3}
    outer = m.classes[0].methods[0]
    assert (outer.position.start_line, outer.position.start_column, outer.position.end_line) == (9, 4, 12)
    c = r["crlf.py"].functions[0]
    assert (c.name, c.complexity, c.parameters, c.position.start_line) == ("f", 2, ["a"], 0)
    assert r["crlf.py"].metrics.total_lines == 4
    n = r["nonl.py"]
    assert [f.body_text for f in n.functions] == ["return 2"] and n.metrics.total_lines == 2
    e = r["empty.py"]
    assert e.functions == [] and (e.metrics.total_lines, e.metrics.blank_lines) == (1, 1)


def test_go_mutations(spark):
    g = _rec(spark, [("m.go", "go", GO)])["m.go"]
    assert [(i.text, i.type) for i in g.imports] == [('import f "fmt"', "named"), ('import "os"', "regular"),
                                                     ('import "embed"', "regular")]
    assert [f.name for f in g.functions] == ["pair"]
    assert g.functions[0].parameters == ["b: int", "s: []string", "p: *T", "q: interface{}"]
    assert g.functions[0].complexity == 3


def test_java_mutations(spark):
    j = _rec(spark, [("Foo.java", "java", JAVA)])["Foo.java"]
    assert j.parser_used == "tree-sitter"
    assert [(i.text, i.type) for i in j.imports] == [("import a.b.C.d;", "regular"), ("import java.util;", "regular")]
    assert [f.name for f in j.functions] == ["toString", "gen"]
    gen = j.functions[1]
    assert gen.parameters == ["arr: T[]"] and gen.complexity == 3
    assert [m.name for m in j.classes[0].methods] == ["toString", "gen"]
    ts = j.classes[0].methods[0]
    assert (ts.position.start_line, ts.position.start_column) == (5, 4)


def test_soft_case_and_bodiless_java_methods(spark):
    py = ("def f(x):\n    match x:\n        case 1:\n            return 1\n        case _:\n            return 2\n"
          "def g(case):\n    y = case + 1\n    return case\n")
    java = "interface I {\n    void a();\n    default int b() { if (true) { return 1; } return 0; }\n}\n"
    r = _rec(spark, [("c.py", "python", py), ("I.java", "java", java)])
    assert {f.name: f.complexity for f in r["c.py"].functions} == {"f": 3, "g": 1}
    j = r["I.java"]
    assert [f.name for f in j.functions] == ["b"]
    # b (complexity 2) and the bodiless a (1) are both method declarations.
    assert j.metrics.average_complexity == 1.5


def test_enclosing_function_matches_brute_force_on_nested_code(spark):
    from codeloom.operators.alerts import enclosing_function
    src = "".join(
        f"def outer{i}(a):\n    x = 1\n    def inner{i}(b):\n        return b\n    return inner{i}\n\n" for i in range(40))
    df = files_df(spark, [("n.py", "python", src)])
    rec = analyse(df)
    spans = rec.select(F.explode("function_spans").alias("s")).select("s.*").collect()
    assert len(spans) == 80
    lines = list(range(0, src.count("\n") + 2, 3))
    alerts = spark.createDataFrame([(f"a{n}", "n.py", n) for n in lines], "alert_id string, file_path string, line_number int")
    got = {r.alert_id: r.enclosing_function for r in enclosing_function(alerts, rec, bucket=8).collect()}
    for n in lines:
        inside = [s for s in spans if s.start_line <= n <= s.end_line]
        exp = max(inside, key=lambda s: s.start_line).name if inside else None
        assert got[f"a{n}"] == exp


def test_a_run_of_lines_closes_a_block_once(spark):
    """The first line that is not deeper ends a block, and only that line is looked at."""
    from codeloom.operators import extract_python as XP
    from codeloom.operators.tokens import token_table
    body = "".join(f"    x{i} = {i}\n" for i in range(60))
    src = f"def f():\n{body}    def g():\n        y = 1\n        z = 2\n{body}class A:\n    def m(self):\n        pass\n    def n(self): pass\n    v = 1\nw = 2\nq = 3\n"
    s, fm = token_table(files_df(spark, [("a.py", "python", src)]), 2)
    d = XP.definitions(XP.prepare(s), fm)
    line = lambda text: src[:src.index(text)].count("\n")
    assert {r["name"]: r.blk_end_line for r in d.collect()} == {
        "f": line("class A") - 1, "g": line("        z"), "A": line("    v = 1"), "m": line("        pass"), "n": line("    def n")}
    plan = re.sub(r"#\d+L?", "", d._jdf.queryExecution().executedPlan().toString())
    closers = [x for x in plan.splitlines() if "Generate explode(filter(levels" in x and "prev_ll_indent" in x]
    assert closers                                             # by the line before, so that a run gives one row for each level
