"""M1–M4 line metrics as array higher-order expressions (no explode, no shuffle).

Lines are ``split(content, '\\n')`` pieces, so a trailing newline adds one
(blank) line and an empty file has one blank line.  "Blank" means the line is
empty after stripping whitespace in the Unicode sense that Python's
``str.strip()`` uses, not just spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that ``str.strip()`` removes (``str.isspace``).
PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}]")

# Comment-line prefixes per language, as regex alternations.
COMMENT_PREFIX_RE = {
    "python": "#",
    "go": "//",
    "java": "//|/\\*",
}


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def _count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda l: l.rlike(pattern)))


def blank_pattern() -> str:
    return f"^{PY_WS}*+$"


def comment_pattern(prefix_re: str) -> str:
    return f"^{PY_WS}*+(?:{prefix_re})"


def line_metric_cols(content: Column, language: Column, more: dict[str, str] | None = None) -> dict[str, Column]:
    """total/blank/comment/code line counts (all INT) for one file row.

    The comment prefix depends on the row's language; one filter per language
    keeps each regex a literal (compiled once per task).  ``more``: prefixes of
    other languages, as regex alternations."""
    lines = lines_of(content)
    total = F.size(lines)
    blank = _count(lines, blank_pattern())
    comment = None
    for lang, pre in (COMMENT_PREFIX_RE | (more or {})).items():
        c = _count(lines, comment_pattern(pre))
        comment = F.when(language == lang, c) if comment is None else comment.when(language == lang, c)
    comment = comment.otherwise(_count(lines, comment_pattern("#")))
    return {
        "total_lines": total.cast("int"),
        "code_lines": (total - blank - comment).cast("int"),
        "comment_lines": comment.cast("int"),
        "blank_lines": blank.cast("int"),
    }
