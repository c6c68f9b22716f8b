"""Generated code corpus ``code``: one source file per ``part`` row.

No driver table holds source code, so files are rendered from ``part`` with
string templates.  The very same SQL expressions run in Spark and in DuckDB
(the oracle), so expected extraction results are closed-form functions of
``p_partkey`` (id) and ``p_size`` (k = p_size % 5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

NL, TAB, BT = "chr(10)", "chr(9)", "chr(96)"
ID = "CAST(p_partkey AS STRING)"
K = "CAST(p_size % 5 AS INTEGER)"

# The three file templates (FIXTURES §2).
PY_TEMPLATE = f"""concat('import os', {NL}, 'from typing import List', {NL}, {NL},
 '# file ', {ID}, ' if else', {NL},
 'def run_', {ID}, '(a, b=1, c: int = 2, *args):', {NL},
 '    s = "if else for"', {NL},
 repeat(concat('    if a:', {NL}, '        a = a - 1', {NL}), {K}),
 '    return [x for x in a]', {NL}, {NL},
 'class K', {ID}, ':', {NL},
 '    def m_', {ID}, '(self, v):', {NL},
 '        while v:', {NL},
 '            v = 0', {NL},
 '        return v', {NL})"""

GO_TEMPLATE = f"""concat('package main', {NL}, {NL}, 'import "fmt"', {NL}, {NL},
 '// comment for if', {NL},
 'func run', {ID}, '(a int, m map[string]int) int {{', {NL},
 repeat(concat({TAB}, 'if a > 0 {{ a-- }}', {NL}), {K}),
 {TAB}, 'for a < 3 {{ a++ }}', {NL},
 {TAB}, 'return a', {NL}, '}}', {NL}, {NL},
 'type T', {ID}, ' struct {{', {NL},
 {TAB}, 'Value int', {NL},
 {TAB}, 'Name *string ', {BT}, 'json:"name"', {BT}, {NL},
 '}}', {NL}, {NL},
 'func (t *T', {ID}, ') Add(a int) int {{ return a }}', {NL})"""

JAVA_TEMPLATE = f"""concat('package p;', {NL}, 'import java.util.List;', {NL},
 'import static java.lang.Math.abs;', {NL}, {NL},
 '/* block if', {NL}, ' * comment', {NL}, ' */', {NL},
 'public class C', {ID}, ' {{', {NL},
 '    // single for', {NL},
 '    public int run', {ID}, '(int a, List<String> b) {{', {NL},
 repeat(concat('        if (a > 0) {{ a--; }}', {NL}), {K}),
 '        for (String s : b) {{ a++; }}', {NL},
 '        return a;', {NL}, '    }}', {NL}, '}}', {NL})"""

LANG_EXPR = "CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'java' END"
EXT_EXPR = "CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' ELSE 'java' END"
PATH_EXPR = f"concat('/repo/b', CAST(p_partkey % 25 AS STRING), '/f_', {ID}, '.', {EXT_EXPR})"
CONTENT_EXPR = (f"CASE p_partkey % 3 WHEN 0 THEN {PY_TEMPLATE} WHEN 1 THEN {GO_TEMPLATE} "
                f"ELSE {JAVA_TEMPLATE} END")
SPARK_CREATED = "timestampadd(MINUTE, p_partkey, TIMESTAMP_NTZ'2024-01-01 00:00:00')"
DUCK_CREATED = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey))"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files(file_path, language, content, created_at, id, k)`` rendered from part.

    Only ``p_partkey`` and ``p_size`` are read (column pruning reaches the scan).
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return part.select(
        F.expr(PATH_EXPR).alias("file_path"),
        F.expr(LANG_EXPR).alias("language"),
        F.expr(CONTENT_EXPR).alias("content"),
        F.expr(SPARK_CREATED).alias("created_at"),
        F.col("p_partkey").alias("id"),
        F.expr(K).alias("k"),
    )


def duck_code_cte() -> str:
    """The DuckDB twin, as a CTE body named ``code``."""
    return (f"code AS (SELECT {PATH_EXPR} AS file_path, {LANG_EXPR} AS language, "
            f"{CONTENT_EXPR} AS content, {DUCK_CREATED} AS created_at, p_partkey AS id, "
            f"{K} AS k FROM part)")
