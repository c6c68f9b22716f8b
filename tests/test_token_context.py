"""The token table against plain counting, and paths whose rows span batches."""

import pyarrow as pa

from codeloom.operators.token_context import _whole_paths
from codeloom.operators.tokens import token_table
from tests.conftest import files_df
from tests.test_properties import _files


def test_positions_depths_and_masks(spark):
    rows = _files(seed=23, per_lang=30)
    s, fm = token_table(files_df(spark, rows), 3)
    content = {p: c for p, _, c in rows}
    got = s.collect()
    assert len(got) > 500
    for r in got:
        c = content[r.file_path]
        before = c[:r.char_off]
        assert c[r.char_off:r.char_end] == r.text
        assert r.line == before.count("\n") and r.ccol == len(before) - before.rfind("\n") - 1
        assert r.bcol == len(before[before.rfind("\n") + 1:].encode())
    masked = {r.file_path: r.masked for r in fm.collect()}
    assert set(masked) == set(content)
    for r in got:
        m = masked[r.file_path]
        assert m[r.char_off:r.char_end] == r.text and m.count("\n") <= content[r.file_path].count("\n")
        if r.text == "{" and r.close is not None:
            inside = m[r.char_off:r.close.char_end]
            assert r.close.text == "}" and m[r.close.char_off] == "}" and inside.startswith("{")


def test_only_relevant_tokens_are_written(spark):
    s, _ = token_table(files_df(spark, [("a.go", "go", "func f(a int) int {\n" + "\tx = y + z * 2\n" * 50 + "}\n")]), 2)
    assert s.count() < 70                                      # of 360 tokens


def test_rows_of_a_path_stay_together():
    batch = lambda *paths: pa.RecordBatch.from_pydict({"file_path": list(paths)})
    got = [b.column(0).to_pylist() for b in _whole_paths(iter([batch("a", "b"), batch("b", "b"), batch("b", "c"), batch("d"), batch(None), batch(None)]))]
    assert got == [["a"], ["b", "b", "b", "b"], ["c"], ["d"], [None, None]]


def test_of_calls_and_lines_only_what_is_looked_up_is_written(spark):
    java = "class A {\n" + "  int f(int a) {\n" + "    g(a); h = \"s\"; if (a > 0) { a--; b = c; }\n" * 50 + "    return a;\n  }\n}\n"
    python = "import os\ndef f(a):\n" + "    if a: x = {1: 2}\n    while x: pass\n" * 50
    go = "package p\nimport \"fmt\"\nfunc f(a int) int {\n" + "\tif a > 0 { g(\"s\") }\n" * 50 + "\treturn a\n}\n"
    s, _ = token_table(files_df(spark, [("a.java", "java", java), ("a.py", "python", python), ("a.go", "go", go)]), 2)
    n = {r["language"]: r["count"] for r in s.groupBy("language").count().collect()}
    assert n["java"] < 310 and n["python"] < 210 and n["go"] < 10          # 655, 356 and 209 with every call, colon, stop and text
    rows = s.where("language = 'python' AND text IN ('def', 'if')").collect()
    assert all((r.t1 is not None) == (r.text == "def") for r in rows)


def test_a_file_is_matched_once(spark, monkeypatch):
    from codeloom.operators import tokens
    groups, pieces = [], tokens._pieces
    monkeypatch.setattr(tokens, "_pieces", lambda c, l, group, p=None: (groups.append(group), pieces(c, l, group, p))[1])
    content = "/* a */ func f() {\n\tx := `é 𝒳`\n} // end"
    s, fm = token_table(files_df(spark, [("a.go", "go", content)]), 2)
    assert groups == [0]
    assert fm.collect()[0].masked == "        func f() {\n\tx := `é 𝒳`\n}       ".replace("\t", " ")
