"""Property checks over randomized sources, batched in one job."""

import random

from pyspark.sql import functions as F

from codeloom.operators import tokens as T
from codeloom.operators.analysis import analyse
from tests.conftest import files_df

PY_LINES = ["def f{n}(a, b=1):", "    if a:", "        return [x for x in b if x]", "    else:", "        pass",
            "class C{n}:", "    def m(self):", "        while self:", "            break", "x = 'if for' # else",
            "", "   ", "# while", "s = \"\"\"multi\nline if\"\"\"", "try:", "    pass", "except E:", "    pass"]
GO_LINES = ["func f{n}(a int) int {", "\tif a > 0 { return 1 }", "\tfor i := 0; i < 3; i++ { }", "\treturn 0",
            "}", "// if else", "/* for */", "s := \"if\"", "type T{n} struct {", "\tA int", "}", ""]
JAVA_LINES = ["class C{n} {", "    int f{n}(int a) {", "        if (a > 0) { return 1; }", "        return 0;",
              "    }", "}", "// while", "/* case */", "String s = \"catch\";", ""]


def _gen(rnd, lines, n):
    return "\n".join(rnd.choice(lines).replace("{n}", str(rnd.randint(0, 99))) for _ in range(rnd.randint(0, 30)))


def _files(seed=11, per_lang=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(per_lang):
        rows.append((f"p{i}.py", "python", _gen(rnd, PY_LINES, i)))
        rows.append((f"g{i}.go", "go", _gen(rnd, GO_LINES, i)))
        rows.append((f"j{i}.java", "java", _gen(rnd, JAVA_LINES, i)))
    return rows


def test_tokens_reconstruct_content(spark):
    rows = _files()
    df = files_df(spark, rows).select(
        "file_path", "content",
        T._pieces(F.col("content"), F.col("language"), 1).alias("tr"),
        T._pieces(F.col("content"), F.col("language"), 2).alias("tk"))
    for r in df.collect():
        joined = "".join(a + b for a, b in zip(r.tr, r.tk))
        assert r.content.startswith(joined)
        assert joined == r.content


def test_metrics_add_up_and_complexity_at_least_one(spark):
    recs = analyse(files_df(spark, _files(seed=5))).collect()
    for r in recs:
        m = r.metrics
        assert m.code_lines + m.comment_lines + m.blank_lines == m.total_lines
        assert all(f.complexity >= 1 for f in r.functions)
        assert all(c.complexity >= 1 for c in r.classes)


def test_keywords_in_comments_and_strings_do_not_change_complexity(spark):
    rows = _files(seed=3, per_lang=20)
    noisy = []
    for fp, lang, c in rows:
        if lang == "python":
            extra = "\n# if else while for except\nz = 'if elif else'"
        else:
            extra = "\n// if else for while case catch\n/* if else */"
        noisy.append((fp, lang, c + extra))
    base = {(r.file_path, f.name, f.position.start_line): f.complexity
            for r in analyse(files_df(spark, rows)).collect() for f in r.functions}
    more = {(r.file_path, f.name, f.position.start_line): f.complexity
            for r in analyse(files_df(spark, noisy)).collect() for f in r.functions}
    assert base == more and len(base) > 20
