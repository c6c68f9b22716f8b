"""V1: the text an analysis record is embedded from, as one JVM expression.

``File: … Language: … Function: n Parameters: a, b Body: … Class: n Methods: …
Body: … Imports: … Metrics: Lines=N, Complexity=x.xx``; empty parts are omitted.
Bodies are whole, or their first ``body_chars`` characters followed by ``...``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _opt(prefix: str, value: Column, cond: Column) -> Column:
    return F.when(cond, F.concat(F.lit(prefix), value)).otherwise(F.lit(""))


def _body(c: Column, cut: int | None) -> Column:
    shown = c if cut is None else F.concat(F.substring(c, 1, cut), F.lit("..."))
    return _opt(" Body: ", shown, F.coalesce(F.length(c) > 0, F.lit(False)))


def text_representation(file_path: Column, language: Column, functions: Column, classes: Column,
                        imports: Column, metrics: Column, body_chars: int | None = None) -> Column:
    funcs = F.transform(functions, lambda f: F.concat(
        F.lit("Function: "), f["name"],
        _opt(" Parameters: ", F.array_join(f["parameters"], ", "), F.size(f["parameters"]) > 0),
        _body(f["body_text"], body_chars)))
    clss = F.transform(classes, lambda c: F.concat(
        F.lit("Class: "), c["name"],
        _opt(" Methods: ", F.array_join(F.transform(c["methods"], lambda m: m["name"]), ", "),
             F.size(c["methods"]) > 0),
        _body(c["body_text"], body_chars)))
    imps = F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "),
                                                 F.array_join(F.transform(imports, lambda i: i["text"]), " ")))
    # Two decimals of the exact value, ties to even as Python formats them.
    cx = F.format_string("%.2f", F.bround(metrics["average_complexity"], 2))
    met = F.concat(F.lit("Metrics: Lines="), metrics["total_lines"].cast("string"), F.lit(", Complexity="), cx)
    parts = F.concat(F.array(F.concat(F.lit("File: "), file_path), F.concat(F.lit("Language: "), language)),
                     funcs, clss, F.array(imps), F.array(met))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")
