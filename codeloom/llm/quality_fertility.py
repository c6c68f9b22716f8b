"""Operator 9: quality rules from tokeniser fertility.

A public vocabulary's merges (``token_counts.PieceModel``) give every text its
characters per token, its share of byte-fallback tokens and its token entropy
(in parts of the most that so many tokens can have).  Each language (the
``lang`` column; texts without one go by their main script) gets a band for
each measure from the quartiles of its documents that pass the base rules, drawn
towards the band of all by n / (n + ``shrink``) for n documents.  The band goes
``width`` interquartile ranges beyond the quartiles, times the spread that texts of
this length have (``spread_by_length``, fitted on all documents).  A text outside
a band, or failing a base rule, is not kept.

Defined results: null text counts as empty (no words, hence base_failed); all
rows stay, repeated ones and null ids too; extra columns named like a result
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, join_counted, materialize, row_groups, unique_name, utf8_buffer
from codeloom.llm.token_counts import piece_model

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
#: Least half-width of a band, where most documents share one value.
SLACK = {"chars_per_token": 0.1, "fallback_share": 0.05, "token_entropy": 0.05}
#: Interquartile ranges beyond the quartiles: over all rows of sf0.1, the least
#: multiple of 0.5 that rejects at most 0.5 % of the labelled good documents that
#: pass the base rules.
WIDTH = 2.5
#: Texts of any length differ by this share of their band's interquartile range.
LEAST_SPREAD = 0.25
#: Documents that the band of all counts for in each language's own band.
SHRINK = 50.0
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.sort((h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:])
    if (h[1:] != h[:-1]).all():                                # no two windows are equal
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    total = upto = 0
    for k, w in enumerate(windows):
        if n[w] > 1:
            total += k + 3 - max(k, upto)
            upto = k + 3
    return total


def entropy(ids: np.ndarray) -> float:
    """Entropy of the token distribution over that of as many distinct tokens."""
    if len(ids) < 2:
        return 0.0
    ids = np.sort(ids)
    n = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
    p = n / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(len(ids)))


def main_script(text: str) -> str:
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = [int(((p >= a) & (p <= b)).sum()) for _, a, b in SCRIPTS]
    return SCRIPTS[int(np.argmax(n))][0] if any(n) else "none"


def measure(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``docs`` without its text, with counts, measures and band_key."""
    bounded_batches(docs.sparkSession)
    new = [*COUNTS, *MEASURES, "band_key"]
    old = [f for f in docs.schema.fields if f.name.lower() not in new and f.name != text_col]
    keep = [f.name for f in old]
    out = T.StructType([*old, *(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(c, T.DoubleType()) for c in MEASURES),
                        T.StructField("band_key", T.StringType())])
    lang = F.lower(F.trim(docs[f"`{lang_col}`"].cast("string"))) if lang_col else F.lit(None).cast("string")
    src = docs.select(*[docs[f"`{c}`"] for c in keep], *(c.alias(x) for c, x in zip((lang, docs[f"`{text_col}`"]), unique_name(docs, "lang", "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        for batch in batches:
            texts, langs = batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2)
            data, offs = utf8_buffer(texts)
            for i, j in row_groups(offs):
                part, o = data[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
                lead = (part & 0xC0) != 0x80
                per_text = [np.diff(np.concatenate([[0], np.cumsum(x)])[o]) for x in (lead & ~white[part], symbol[part], lead)]
                raw, strs = part.tobytes(), [t or "" for t in texts.slice(i, j - i).to_pylist()]
                pre = [model.pretokens(t) for t in strs]
                model.tokens.learn(set().union(*pre))
                get, rows = model.tokens.__getitem__, []
                for k, (words_of, t) in enumerate(zip(pre, strs)):
                    text = raw[o[k]: o[k + 1]]
                    words = text.split()
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    tok = np.frombuffer(b"".join(map(get, words_of)), "<u4")
                    low = int(((tok >= model.byte0) & (tok < model.byte0 + 256) & (tok != model.byte0 + 10)).sum())
                    rows.append((len(words), len(lines) - len(set(lines)), repeated_words(words), per_text[2][k] / max(len(tok), 1),
                                 low / max(len(tok), 1), entropy(tok), langs[i + k].as_py() or f"script:{main_script(t)}"))
                w, d, r, c, b, e, key = zip(*rows)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-2], pa.array(w, pa.int64()), pa.array(per_text[0]), pa.array(per_text[1]),
                                                  pa.array(d, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.float64()), pa.array(b, pa.float64()),
                                                  pa.array(e, pa.float64()), pa.array(key, pa.string())], names=[*keep, *new])

    return src.mapInArrow(run, out)


def _by_octave(rows: DataFrame, cuts: list[float]) -> list:
    """Documents, means of 1 / log2(n) and 1 / n, and quantiles of each measure, for
    each octave of length n in words: a few dozen rows at most."""
    n = F.greatest(F.col("n_words"), F.lit(2))
    q = [F.percentile_approx(c, cuts, 10_000).alias(c) for c in MEASURES]
    return rows.groupBy(F.floor(F.log2(n)).alias("octave")).agg(F.count("*").alias("n"), F.avg(1 / F.log2(n)).alias("length"), F.avg(1 / n).alias("inverse"), *q).collect()


def _line(n, x, y) -> tuple[float, float]:
    """Weighted least squares: (value at x = 0, slope)."""
    mx, my = np.average(x, weights=n), np.average(y, weights=n)
    slope = (n * (x - mx) * (y - my)).sum() / max((n * (x - mx) ** 2).sum(), 1e-30)
    return float(my - slope * mx), float(slope)


def drift_by_length(rows: DataFrame) -> dict[str, float]:
    """The slope of each measure's median over 1 / log2(n) for texts of n words,
    fitted over octaves of length.  (The tokens of a long text have an entropy that
    hardly grows any more, so its share of log2 of their number falls like that.)"""
    got = _by_octave(rows, [0.5])
    return {c: _line(*np.array([(r["n"], r["length"], r[c][0]) for r in got], float).T)[1] if len(got) > 1 else 0.0 for c in MEASURES}


def spread_by_length(scaled: DataFrame) -> dict[str, tuple[float, float]]:
    """(a, b) for each measure: the squared interquartile range of its deviation
    from its band's centre, in interquartile ranges of its band, is a + b / n for
    texts of n words (what texts differ in, and what a sample of n words adds),
    fitted over octaves of length."""
    got = _by_octave(scaled, [0.25, 0.75])
    out = {}
    for c in MEASURES:
        n, x, y = np.array([(r["n"], r["inverse"], (r[c][1] - r[c][0]) ** 2) for r in got if r[c]], float).reshape(-1, 3).T
        if len(n):
            mx, my = np.average(x, weights=n), np.average(y, weights=n)
            b = min(max(_line(n, x, y)[1], 0.0), my / mx)      # neither part is negative
            out[c] = (max(float(my - b * mx), LEAST_SPREAD ** 2), float(b))
        else:
            out[c] = (1.0, 0.0)
    return out


def apply_bands(m: DataFrame, width: float = WIDTH, shrink: float = SHRINK) -> DataFrame:
    """``measure``'s columns (with base_failed) and kept."""
    good = m.filter(~F.col("base_failed"))
    level = {c: f"level_{c}" for c in MEASURES}                # the measure at one length
    drift = drift_by_length(good)
    flat = m.select("*", *[(F.col(c) - drift[c] / F.log2(F.greatest(F.col("n_words"), F.lit(2)))).alias(v) for c, v in level.items()])
    quart = [F.percentile_approx(level[c], [0.25, 0.75], 10_000) for c in MEASURES]
    good = flat.filter(~F.col("base_failed"))
    every = good.agg(*[q.alias(f"all_{c}") for c, q in zip(MEASURES, quart)])      # one row
    group = materialize(good.groupBy("band_key").agg(*[q.alias(f"own_{c}") for c, q in zip(MEASURES, quart)], F.count("*").alias("n_group")), "fertility-bands")
    x = join_counted(flat, group, ["band_key"]).join(F.broadcast(every))
    weight = F.coalesce(F.col("n_group") / (F.col("n_group") + shrink), F.lit(0.0))
    for c in MEASURES:
        for k, end in enumerate(("low", "high")):
            of_all = F.col(f"all_{c}")[k]
            x = x.withColumn(f"{end}_{c}", weight * F.coalesce(F.col(f"own_{c}")[k], of_all) + (1 - weight) * of_all)
    iqr = {c: F.col(f"high_{c}") - F.col(f"low_{c}") for c in MEASURES}
    off = {c: F.col(level[c]) - (F.col(f"high_{c}") + F.col(f"low_{c}")) / 2 for c in MEASURES}
    scaled = x.filter(~F.col("base_failed")).select("n_words", *[(off[c] / F.nullif(iqr[c], F.lit(0.0))).alias(c) for c in MEASURES])
    inside = F.lit(True)
    for c, (a, b) in spread_by_length(scaled).items():
        wide = iqr[c] * F.sqrt(a + b / F.greatest(F.col("n_words"), F.lit(1)))
        inside = inside & F.coalesce(F.abs(off[c]) <= wide / 2 + F.greatest(width * wide, F.lit(SLACK[c])), F.lit(True))
    return x.select(*[m[f"`{c}`"] for c in m.columns if c != "band_key"], "band_key", (~F.col("base_failed") & inside).alias("kept"))


def judge(docs: DataFrame, path: str, text_col: str = "text", lang_col: str | None = "lang", width: float = WIDTH, shrink: float = SHRINK) -> DataFrame:
    """``measure``'s columns with base_failed, kept and the bands applied."""
    m = measure(docs, path, text_col, lang_col)
    m = m.select(*[c for c in m.columns if c.lower() not in ("base_failed", "kept")],
                 ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))
    return apply_bands(materialize(m, "fertility"), width, shrink)
