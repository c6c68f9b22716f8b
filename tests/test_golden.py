"""Literal expected records for small sources of each language."""

from codeloom.operators.analysis import analyse
from tests.conftest import files_df

PY = '''import sys; import os.path
from shapes import (Box,
                    Ring)

async def läuft(n, *, step: int):
    for i in range(n):
        yield i if i else 0

class Queue(Box):
    @property
    def size(self): return 0

    def push(self, item):
        def inner(): pass
        while item:
            item = None
'''

GO = '''package shop

import (
\tstr "strings"
\t"os"
)

type (
\tOrder struct {
\t\tID, Qty int `json:"q"`
\t}
\tNote struct{ Text *string }
)

func total(xs []int, f func(int) int) int {
\tfor _, x := range xs {
\t\tif x > 0 { f(x) }
\t}
\treturn 0
}

func (o *Order) Drop() {}
'''

JAVA = '''package shop;
import java.io.File;

abstract class Till {
    Till(int drawer) { this.drawer = drawer; }
    int drawer;
    void add(@Range({1, 9}) long coin, final Map<String, Long> by) throws E {
        for (;;) { if (coin > 0) break; }
    }
    abstract int sum(int[] xs);
}
'''


def _records(spark, *files):
    return {r.file_path: r for r in analyse(files_df(spark, list(files))).collect()}


def test_python_record(spark):
    r = _records(spark, ("a.py", "python", PY))["a.py"]
    assert [(f.name, f.parameters, f.complexity) for f in r.functions] == [
        ("läuft", ["n", "step"], 4), ("size", ["self"], 1), ("push", ["self", "item"], 2), ("inner", [], 1)]
    assert [(c.name, [m.name for m in c.methods]) for c in r.classes] == [("Queue", ["push"])]
    assert [(i.text, i.type) for i in r.imports] == [("sys", "import"), ("os.path", "import"), ("shapes", "import_from"),
                                                     ("Box", "import_from"), ("Ring", "import_from")]
    assert (r.functions[0].position.start_line, r.functions[0].position.start_column, r.functions[0].position.end_column) == (4, 10, 16)


def test_go_record(spark):
    r = _records(spark, ("a.go", "go", GO))["a.go"]
    assert [(f.name, f.complexity) for f in r.functions] == [("total", 3)]
    assert [(s.name, [(x.name, x.type, x.tag) for x in s.fields]) for s in r.structs] == [
        ("Order", [("Qty", "int", '`json:"q"`')]), ("Note", [("Text", "*string", None)])]
    assert [(i.text, i.type) for i in r.imports] == [('import str "strings"', "named"), ('import "os"', "regular")]
    assert r.classes == []


def test_java_record(spark):
    r = _records(spark, ("A.java", "java", JAVA))["A.java"]
    assert [(f.name, f.parameters, f.complexity) for f in r.functions] == [("add", ["coin: Object", "by: Map<String, Long>"], 3)]
    assert [(c.name, [m.name for m in c.methods]) for c in r.classes] == [("Till", ["add"])]
    assert [(i.text, i.type) for i in r.imports] == [("import java.io.File;", "regular")]


def test_imports_inside_a_line(spark):
    src = "x = 1; import os\ntry: import json\nexcept E: pass\nif x: from a import b\nlam = {1: 2}\nraise E from os\n"
    r = _records(spark, ("a.py", "python", src))["a.py"]
    assert [(i.text, i.type) for i in r.imports] == [("os", "import"), ("json", "import"), ("a", "import_from"), ("b", "import_from")]


def test_keywords_in_strings_and_comments_do_not_count(spark):
    src = 'def f(x):\n    s = "if for while"  # if else\n    return x\n'
    src2 = 'def f(x):\n    s = "if"\n    if x:\n        pass\n    return x\n'
    df = files_df(spark, [("a.py", "python", src), ("b.py", "python", src2)])
    r = {x.file_path: x for x in analyse(df).collect()}
    assert r["a.py"].functions[0].complexity == 1
    assert r["b.py"].functions[0].complexity == 2


def test_keywords_in_interpolations_count(spark):
    src = 'def f(a):\n    return f"{1 if a else 2} if {{for}} {a[\'if\']}" + "{x if y else z}"\n'
    assert _records(spark, ("a.py", "python", src))["a.py"].functions[0].complexity == 3


def test_line_metric_edges(spark):
    df = files_df(spark, [("e.py", "python", ""), ("c.py", "python", "x = 1\r\n# c\r\n"),
                          ("n.go", "go", "package main")])
    r = {x.file_path: x.metrics for x in analyse(df).collect()}
    assert (r["e.py"].total_lines, r["e.py"].blank_lines) == (1, 1)
    assert (r["c.py"].total_lines, r["c.py"].code_lines, r["c.py"].comment_lines, r["c.py"].blank_lines) == (3, 1, 1, 1)
    assert (r["n.go"].total_lines, r["n.go"].code_lines) == (1, 1)


def test_unbalanced_java_goes_to_regex_path(spark):
    src = "public class A {\n    public void f() {\n        x();\n"
    df = files_df(spark, [("A.java", "java", src)])
    r = analyse(df).collect()[0]
    assert r.parser_used == "regex"
    assert [f.name for f in r.functions] == ["f"] and r.metrics.average_complexity == 1.0
