"""Operator 3: toxicity by a character n-gram linear classifier with naive Bayes feature scaling.

Features are the presence of hashed character n-grams (UTF-8 bytes, ASCII
lower-cased, white space runs as one space).  Over all labelled training rows,
document counts of each n-gram by class give smoothed log-count ratios; every
n-gram that is at least twice as frequent in one class as in the other, and whose
ratio is at least ``z_min`` standard errors from zero, is a feature, however many
those are, and each feature's value is its ratio.  (All n-grams that
occur, without that test, score worse on held-out rows: see the README.)  A logistic regression over the scaled features is
fitted on about ``fit_rows`` labelled rows (the documented bound; those whose
ids hash below the share that it is of all), and scores every whole text.

Counts are summed in tasks before Spark sums the tasks'; the model's size is
bounded by ``bits``.

Defined results: null and empty texts have no feature and get the score of the
intercept; labels of rows without a text, unlabelled rows and null labels teach
nothing; an id with several labels counts as toxic if one says so; repeated rows
are scored alike; columns named like a result are replaced; without training
rows of both classes every score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import bounded_batches, join_counted, materialize, row_groups, unique_name, utf8_buffer

SIZES = (4, 5, 6)
BITS = 20
Z_MIN, FIT_ROWS = 3.0, 20_000
#: Twice as frequent; what differs less is scaled to little, yet occurs in most texts.
RATIO_MIN = float(np.log(2))
LABEL_ROWS = 500_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def document_grams(data: np.ndarray, offs: np.ndarray, sizes=SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of every row of a chunk."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    x = _FOLD[data]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each row is read with a space before its text; runs of white space are one
    head = np.concatenate([[True], row[1:] != row[:-1]])
    keep = (x != 32) | np.concatenate([[True], x[:-1] != 32]) | head
    x, row = x[keep], row[keep]
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    x, row = np.insert(x, head, 32), np.insert(row, head, row[head])
    rows, buckets = [], []
    h = x.astype(np.uint32)
    for k in range(1, max(sizes)):
        if len(x) <= k:
            break
        h = h[:-1] * np.uint32(0x01000193) + x[k:]             # of the k + 1 bytes from each place
        if k + 1 in sizes:
            same = row[: len(h)] == row[k:]
            b = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761 + 2 * k)) >> np.uint32(32 - bits)
            rows.append(row[: len(h)][same])
            buckets.append(b[same].astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, buckets = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(rows, kind="stable")
    rows, buckets = rows[order], buckets[order]
    last, out = np.empty(1 << bits, np.int64), np.zeros(len(rows), bool)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):    # first place of each bucket in its row
        b = buckets[a:z]
        place = np.arange(a, z)
        last[b] = place
        out[a:z] = last[b] == place
    return rows[out], buckets[out]


def count_ratios(train: DataFrame, bits: int, z_min: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Buckets and log-count ratios of the kept features, rows of either class."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((2, size), np.int64), np.zeros(2, np.int64)
        for b in batches:
            y = b.column(1).to_numpy().astype(np.int64)
            total += np.bincount(y, minlength=2)
            data, offs = utf8_buffer(b.column(0))
            for i, j in row_groups(offs):
                rows, buckets = document_grams(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i], bits=bits)
                n += np.bincount(y[i:j][rows] * size + buckets, minlength=2 * size).reshape(2, size)
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], total[0])), pa.array(np.append(n[1, at], total[1]))], names=["bucket", "n0", "n1"])

    sums = train.select("text", "y").mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = materialize(sums, "gram-counts")
    total = sums.filter("bucket = -1").first()
    n0, n1 = (int(total["n0"] or 0), int(total["n1"] or 0)) if total else (0, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), n0, n1
    # difference of smoothed log odds over its standard error
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    ratio = F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0))
    z = F.abs(ratio) / F.sqrt(1 / a + 1 / b)
    top = sums.filter("bucket >= 0").select("bucket", ratio.alias("r"), z.alias("z")).filter((F.col("z") >= z_min) & (F.abs("r") >= RATIO_MIN)).select("bucket", "r").toPandas()
    top = top.sort_values("bucket")
    return top["bucket"].to_numpy(np.int64), top["r"].to_numpy(float), n0, n1


def _kept(data, offs, slot, bits):
    """(row, feature) of the kept n-grams of every row of a chunk."""
    rows, buckets = document_grams(data, offs, bits=bits)
    f = slot[buckets]
    return rows[f >= 0], f[f >= 0]


def fit_logistic(features: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 300, piece: int = 1 << 20) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps, until they change by
    less than a thousandth in ten.  ``features``: those of each row, whose values
    are their ratios.  Rows are gone through in pieces, so beside the features
    themselves (4 bytes each) memory holds one piece."""
    n, none = len(y), len(ratios)
    size = np.array([len(f) + 1 for f in features])            # one absent feature more: no row is empty
    ends = np.cumsum(size)
    cuts = [0, *(np.searchsorted(ends, np.arange(piece, ends[-1] + piece, piece), side="left") + 1).clip(max=n).tolist()]
    pieces = []
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            pieces.append((np.concatenate([x for f in features[a:b] for x in (f, [none])]).astype(np.int32), np.cumsum(size[a:b]) - size[a:b], slice(a, b)))
    values = np.append(ratios, 0.0)

    def forward(w):
        scaled = values * w
        return np.concatenate([np.add.reduceat(scaled[c], s) for c, s, _ in pieces])

    def back(e):
        return values * sum(np.bincount(c, np.repeat(e[r], size[r]), none + 1) for c, _, r in pieces)

    w, v = np.zeros(none + 1), np.zeros(none + 1)
    bias = bias_v = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    p, p_bias, top = np.ones(none + 1), 1.0, 1.0               # a bound of the curvature by some power steps
    for _ in range(10):
        q = forward(p) + p_bias
        p, p_bias = back(q), q.sum()
        top = float(np.sqrt((p * p).sum() + p_bias ** 2))
        p, p_bias = p / top, p_bias / top
    rate, t, before = 1 / (0.25 * top * 1.2 + ridge), 1.0, None
    for k in range(steps):
        e = 1 / (1 + np.exp(-np.clip(forward(v) + bias_v, -50, 50))) - y
        new, new_bias = v - rate * (back(e) + ridge * v), bias_v - rate * e.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = new + (t - 1) / s * (new - w), new_bias + (t - 1) / s * (new_bias - bias)
        w, bias, t = new, new_bias, s
        if k % 10 == 9:
            if before is not None and np.linalg.norm(w - before) < 1e-3 * np.linalg.norm(w):
                break
            before = w
    return w[:-1], float(bias)


def score(docs: DataFrame, labelled: DataFrame, text_col: str = "text", bits: int = BITS, z_min: float = Z_MIN, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without its text, with score.  ``labelled``: (id, text, y), each
    labelled text with its class 0 or 1; ``id`` only orders the fitted rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    train = labelled.filter("text is not null and y is not null").select("id", "text", F.col("y").cast("int").alias("y"))
    buckets, ratios, n0, n1 = count_ratios(train, bits, z_min)
    weights, bias = np.zeros(len(buckets)), float(np.log((n1 + 1e-9) / (n0 + 1e-9))) if n0 + n1 else -30.0
    slot = np.full(1 << bits, -1, np.int32)
    slot[buckets] = np.arange(len(buckets))
    slots = spark.sparkContext.broadcast(slot)                 # 4 MB at 20 bits
    if len(buckets):
        def vectors(batches):
            for b in batches:
                data, offs = utf8_buffer(b.column(0))
                for i, j in row_groups(offs):
                    r, f = _kept(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i], slots.value, bits)
                    at = np.searchsorted(r, np.arange(j - i + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([f[x:y].astype("<i4").tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()),
                                                      b.column(1).slice(i, j - i)], names=["f", "y"])
        share = min(1.0, fit_rows / (n0 + n1))
        chosen = train.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
        got = chosen.select("text", "y").mapInArrow(vectors, "f binary, y int").toPandas()
        weights, bias = fit_logistic([np.frombuffer(f, "<i4") for f in got["f"]], ratios, got["y"].to_numpy(float))
    model = spark.sparkContext.broadcast((weights * ratios, bias))
    old = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() != "score"]
    keep = [f.name for f in old]
    src = docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text_col}`"].alias(*unique_name(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = model.value
        for b in batches:
            data, offs = utf8_buffer(b.column(b.num_columns - 1))
            m = np.full(b.num_rows, c)
            for i, j in row_groups(offs):
                r, f = _kept(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i], slots.value, bits)
                m[i:j] += np.bincount(r, w[f], j - i)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))))], names=[*keep, "score"])

    return src.mapInArrow(run, T.StructType([*old, T.StructField("score", T.DoubleType())]))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score and predicted for every row of ``docs``."""
    known = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").alias("y")).filter("id is not null and y in (0, 1)")
    ids = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    # ids and classes, 16 bytes a row: sent out up to LABEL_ROWS, else texts meet them in a shuffle
    known = materialize(known.filter(~held_out(F.col("id"))), "labels")
    labelled = join_counted(ids.filter(~held_out(F.col("id"))), known, ["id"], "inner", limit=LABEL_ROWS)
    out = score(docs.select(id_col, text_col), labelled, text_col)
    return out.select(id_col, held_out(F.col(f"`{id_col}`")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
