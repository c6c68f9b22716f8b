"""Operator 8: language identification by Bayesian evidence fusion.

The log-posterior of a language adds up
* the text's log-likelihood: hashed character trigrams (lower-cased ASCII,
  UTF-8 bytes), Laplace-smoothed counts summed over all rows whose declared
  language is a supported one; divided by three, since trigrams overlap;
* the declared markup language: its smoothed confusion counts with the
  languages that the text alone favours;
* the address suffix: the same kind of counts for the last label of the host;
* a host prior smoothed towards its suffix's, that one towards the global one
  (Dirichlet weights), from grouped sums over all rows without the row itself.
A further class ``und`` has uniform trigrams; rows that it wins, or whose best
language stays under ``min_confidence``, are rejected.

Only trigrams of letters and spaces count, so that numbers and marks are no
evidence against any language.

Defined results: null and empty texts and those without a letter are ``und``,
confidence 0 and rejected; a text too short for a trigram goes by its
declaration and host; a null or unsupported declaration and a null
host are no evidence; all rows stay (``accepted`` tells the verdict), repeated
rows get the same answer, extra columns stay, those named like a result are
replaced; a table without declared rows has no model: everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, join_counted, materialize, row_groups, unique_name, utf8_buffer

LANGUAGES = ("en", "fr", "de", "es")
BITS = 14
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)                                  # ASCII letters and all bytes of other characters
_LETTER[97:123] = _LETTER[128:] = True


def trigram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte of a chunk, and whether it counts: it
    lies within one text and is of letters, or of spaces and letters."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = _LOWER[data]
    v = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    b = ((v * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    letter, space = _LETTER[x], x == 32
    fine = letter | space
    ok = fine[:-2] & fine[1:-1] & fine[2:] & (letter[:-2] | letter[1:-1] | letter[2:])
    ends = offs[1:]
    for k in (1, 2):                                           # starts whose trigram runs over an end
        at = ends - k
        ok[at[(at >= 0) & (at < len(b))]] = False
    return b, ok


def _declared(col, languages):
    """Index of a supported declared language (primary subtag), else -1."""
    tag = F.lower(F.element_at(F.split(F.trim(col.cast("string")), "[-_]"), 1))
    out = F.lit(-1)
    for k, name in enumerate(languages):
        out = F.when(tag == name, F.lit(k)).otherwise(out)
    return out.cast("int")


def train(rows: DataFrame, languages=LANGUAGES) -> np.ndarray | None:
    """Log-probabilities (trigram bucket, language) from ``__text`` and
    ``__declared``.  Tasks add up their own counts, Spark adds up the tasks';
    the model's size is fixed: 2**BITS buckets for each language."""
    size, n = 1 << BITS, len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * size, np.int64)
        for batch in batches:
            declared = batch.column("__declared").to_numpy(zero_copy_only=False).astype(np.int64)
            data, offs = utf8_buffer(batch.column("__text"))
            for i, j in row_groups(offs):
                o = offs[i: j + 1] - offs[i]
                b, ok = trigram_buckets(data[offs[i]: offs[j]], o)
                if len(b):
                    lang = np.repeat(declared[i:j], np.diff(o))[: len(b)]
                    ok &= lang >= 0
                    total += np.bincount(lang[ok] * size + b[ok], minlength=n * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = (rows.filter("__declared >= 0").select("__text", "__declared").mapInArrow(count, "cell long, n long")
           .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    if not len(got):
        return None
    c = np.zeros(n * size)
    c[got["cell"].to_numpy()] = got["n"].to_numpy()
    c = c.reshape(n, size).T
    return np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * size)).astype(np.float32)


def _per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return np.diff(cum[np.minimum(offs, len(values))])


def _text_evidence(model: np.ndarray | None, n: int, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihoods (row, language or und last) and letters per row."""
    out = np.zeros((len(offs) - 1, n + 1))
    letters = _per_text(_LETTER[_LOWER[data]], offs)
    b, ok = trigram_buckets(data, offs)
    grams = _per_text(ok, offs)
    out[:, n] = -BITS * np.log(2) * grams / 3
    for k in range(n):
        out[:, k] = out[:, n] - 1e3 if model is None else _per_text(np.where(ok, model[:, k][b], 0), offs) / 3
    return out, letters


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def identify(df: DataFrame, text_col: str = "text", declared_col: str | None = None, host_col: str | None = None,
             suffix_col: str | None = None, languages=LANGUAGES, host_weight: float = 20.0, suffix_weight: float = 50.0,
             min_confidence: float = 0.5) -> DataFrame:
    """``df`` with language, confidence (the posterior), accepted."""
    spark, n = df.sparkSession, len(languages)
    bounded_batches(spark)
    new = ["language", "confidence", "accepted"]
    keep = [c for c in df.columns if c.lower() not in new]
    kept = [f"c{i}" for i in range(len(keep))]                 # under way, so that no name clashes
    null = F.lit(None).cast("string")
    rows = df.select(*[df[f"`{c}`"].alias(k) for c, k in zip(keep, kept)], df[f"`{text_col}`"].alias("__text"),
                     (_declared(df[f"`{declared_col}`"], languages) if declared_col else F.lit(-1)).alias("__declared"),
                     (df[f"`{host_col}`"].cast("string") if host_col else null).alias("__host"),
                     (df[f"`{suffix_col}`"].cast("string") if suffix_col else null).alias("__suffix"))
    model = spark.sparkContext.broadcast(train(rows, languages))

    def alone(batches):
        """Text-only posterior mass, added up per (suffix, host, declared) in the task."""
        for batch in batches:
            p = np.zeros((batch.num_rows, n))
            data, offs = utf8_buffer(batch.column("__text"))
            for i, j in row_groups(offs):
                x, letters = _text_evidence(model.value, n, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                p[i:j] = _softmax(x)[:, :n] * (letters > 0)[:, None]
            frame = batch.select(["__suffix", "__host", "__declared"]).to_pandas()
            for k in range(n):
                frame[f"p{k}"] = p[:, k]
            frame = frame.groupby(["__suffix", "__host", "__declared"], dropna=False, as_index=False).sum()
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False, schema=pa.schema(
                [("__suffix", pa.string()), ("__host", pa.string()), ("__declared", pa.int32()), *((f"p{k}", pa.float64()) for k in range(n))]))

    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]
    cells = ", ".join(f"p{k} double" for k in range(n))
    mass = materialize(rows.select("__text", "__suffix", "__host", "__declared")
                       .mapInArrow(alone, f"__suffix string, __host string, __declared int, {cells}")
                       .groupBy("__suffix", "__host", "__declared").agg(*sums), "language-evidence")
    confusion = np.ones((n + 1, n))                            # declared (none last) x language, bounded
    for r in mass.groupBy("__declared").agg(*sums).collect():
        confusion[r[0], :] += [r[k + 1] for k in range(n)]     # -1 is the last row
    glob = confusion.sum(axis=0) / confusion.sum()
    says = np.log((confusion + 0.0) / confusion.sum(axis=0))
    says[n] = 0.0                                              # no declaration, no evidence

    def summed(key):
        s = mass.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*sums).alias(f"{key}_mass"))
        return materialize(s, "language-prior")

    joined = rows
    for key, col in (("__host", host_col), ("__suffix", suffix_col)):
        joined = join_counted(joined, summed(key), [key]) if col else joined.withColumn(f"{key}_mass", F.lit(None).cast("array<double>"))

    def decide(batches):
        for batch in batches:
            data, offs = utf8_buffer(batch.column("__text"))
            declared = batch.column("__declared").to_numpy(zero_copy_only=False).astype(np.int64)
            host, suffix = (np.array([x or [0.0] * n for x in batch.column(f"{c}_mass").to_pylist()]).reshape(-1, n) for c in ("__host", "__suffix"))
            lang, conf = np.full(batch.num_rows, n), np.zeros(batch.num_rows)
            for i, j in row_groups(offs):
                x, letters = _text_evidence(model.value, n, data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                own = _softmax(x)[:, :n] * (letters > 0)[:, None]
                s, h = np.maximum(suffix[i:j] - own, 0), np.maximum(host[i:j] - own, 0)
                base = (s + suffix_weight * glob) / (s.sum(axis=1, keepdims=True) + suffix_weight)
                prior = (h + host_weight * base) / (h.sum(axis=1, keepdims=True) + host_weight)
                x[:, :n] += np.log(prior) + says[declared[i:j]]
                x[:, n] += np.log(0.25 / n)
                p = _softmax(x)
                lang[i:j], conf[i:j] = p.argmax(axis=1), p.max(axis=1)
                none = letters == 0
                lang[i:j][none], conf[i:j][none] = n, 0.0
            names = np.array([*languages, UNDETERMINED], object)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names[lang], pa.string()), pa.array(conf),
                                              pa.array((lang < n) & (conf >= min_confidence))], names=[*keep, *new])

    types = {f.name: f for f in df.schema.fields}
    out = T.StructType([*(types[c] for c in keep), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return joined.select(*kept, "__text", "__declared", "__host_mass", "__suffix_mass").mapInArrow(decide, out)


def page_columns(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` with page_text (no markup), page_lang (the root element's
    declaration), page_host and page_suffix (its last label)."""
    from codeloom.llm.url_filter import host_and_path

    html = F.coalesce(pages[f"`{html_col}`"].cast("string"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*+>", " ")
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    host = F.nullif(host_and_path(pages[f"`{url_col}`"].cast("string"))[0], F.lit(""))
    return pages.withColumns({"page_text": F.regexp_replace(bare, r"&\w+;|&#\d+;", " "), "page_lang": declared,
                              "page_host": host, "page_suffix": F.regexp_extract(host, r"([^.]+)$", 1)})
