"""Host → container path remapping.

The mapping is configuration (a handful of prefixes), so it is compiled into
one CASE expression — longest prefix first, exact match or prefix + '/' — and
costs a projection: no join, no shuffle.  Only the leading prefix is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def remap_path(path: Column, mapping: list[tuple[str, str]]) -> Column:
    expr = None
    for src, dst in sorted(mapping, key=lambda m: -len(m[0])):
        src = src.rstrip("/")
        hit = (path == F.lit(src)) | path.startswith(src + "/")
        val = F.concat(F.lit(dst.rstrip("/")), F.expr(f"substring({_name(path)}, {len(src) + 1})"))
        expr = F.when(hit, val) if expr is None else expr.when(hit, val)
    return path if expr is None else expr.otherwise(path)


def _name(c: Column) -> str:
    return c._jc.toString()


def duck_remap_sql(path: str, mapping: list[tuple[str, str]]) -> str:
    parts = []
    for src, dst in sorted(mapping, key=lambda m: -len(m[0])):
        src = src.rstrip("/")
        parts.append(f"WHEN {path} = '{src}' OR starts_with({path}, '{src}/') THEN "
                     f"concat('{dst.rstrip('/')}', substring({path}, {len(src) + 1}))")
    return "CASE " + " ".join(parts) + f" ELSE {path} END"
