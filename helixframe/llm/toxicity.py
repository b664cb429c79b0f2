"""Toxicity scoring: a character n-gram linear classifier with naive Bayes features (operator 6).

Features are hashed character n-grams of the lower-cased text (present or not), each scaled
by its log-count ratio between toxic and other training texts, less ``SHRINK`` standard errors of
that ratio: an n-gram that few texts show counts for little, and no fixed number of texts is asked
for.  A logistic regression in which both classes weigh the same is trained on the scaled features.

The classifier is fitted on a bounded sample of labelled rows (``max_train``, those
with the smallest hash of their id); every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release

MAX_TRAIN = 4_000
ORDERS = (4, 5, 6, 7, 8)
BITS = 20
SMOOTHING = 1.0
#: Standard errors by which each log-count ratio is drawn towards 0.
SHRINK = 3.0
STEPS = 300
RIDGE = 1e-4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of the text's words, white space as one space, with a space at both ends."""
    plain = f" {' '.join((text or '').lower().split())} "
    h = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = h * _M1
    h, found = own, []
    for order in range(2, max(ORDERS) + 1):
        if len(own) < order:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _M2 + own[order - 1 :]
        if order in ORDERS:
            found.append(((h * _M1) >> np.uint64(64 - BITS)).astype(np.uint32))
    if not found:
        return np.empty(0, np.uint32)
    h = np.sort(np.concatenate(found))
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, eligible, max_train: int, id_column: str, text_column: str) -> DataFrame:
    """text, y of at most ``max_train`` labelled documents; the ids are few enough to broadcast by that bound."""
    own = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & eligible)
    one = own.groupBy(F.col(id_column).cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    picked = one.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train).collect()
    rows = documents.sparkSession.createDataFrame([(r["label_id"], int(r["y"] > 0)) for r in picked], "label_id long, y int")
    return documents.select(F.col(id_column).cast("long").alias("label_id"), F.col(text_column).alias("text")).join(F.broadcast(rows), "label_id").select("text", "y")


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of all hashed features (0 where not kept) and the bias."""

    def count(source):
        held = np.zeros((2, 1 << BITS), np.int32)
        rows = np.zeros(2, np.int64)
        for b in source:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[y][features(text)] += 1
                rows[y] += 1
        at = np.flatnonzero(held.sum(axis=0))
        if rows.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[0][at], rows[0]).astype(np.int64)), pa.array(np.append(held[1][at], rows[1]).astype(np.int64))], names=["feature", "clean", "toxic"])

    counted = sample.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counted.toArrow()  # 2**BITS rows and a total at most
    feature, clean, toxic = (table.column(c).to_numpy().astype(np.float64) for c in ("feature", "clean", "toxic"))
    weights = np.zeros(1 << BITS)
    total = feature < 0
    n0, n1 = float(clean[total].sum()), float(toxic[total].sum())
    if not n0 or not n1:
        return weights, (1 if n1 else -1) * 2.0
    feature, clean, toxic = feature[~total].astype(np.int64), clean[~total], toxic[~total]
    p1, p0 = (toxic + SMOOTHING) / (n1 + 2 * SMOOTHING), (clean + SMOOTHING) / (n0 + 2 * SMOOTHING)
    ratio = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
    error = np.sqrt(1 / (toxic + SMOOTHING) + 1 / (clean + SMOOTHING) + 1 / (n1 - toxic + SMOOTHING) + 1 / (n0 - clean + SMOOTHING))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - SHRINK * error)
    kept = ratio != 0
    feature, ratio = feature[kept], ratio[kept]
    number = np.full(1 << BITS, -1, np.int32)
    number[feature] = np.arange(len(feature))
    numbers = sample.sparkSession.sparkContext.broadcast(number)

    def select(source):
        for b in source:
            rows = [(n := numbers.value[features(t)])[n >= 0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["y", "kept"])

    held = sample.mapInArrow(select, "y int, kept array<int>").toArrow()  # max_train rows at most
    y = held.column("y").to_numpy().astype(np.float64)
    lists = held.column("kept").combine_chunks()
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    w, bias = _logistic(np.repeat(np.arange(len(y), dtype=np.int32), lengths), np.asarray(lists.flatten()), y, ratio)
    weights[feature] = w * ratio
    del held, lists, lengths, number
    release(sample.sparkSession)
    return weights, bias


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on features ``scale[col]`` by Adam; a plain full-batch loop.

    Entries are held by row (``row`` rises) and by column, four bytes each, so that sums run along them.
    """
    w, bias = np.full(len(scale), 0.02), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rows, row_starts = np.unique(row, return_index=True)
    order = np.argsort(col, kind="stable")
    row_of, (cols, col_starts) = row[order], np.unique(col[order], return_index=True)
    del order
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)  # both classes weigh the same
    for t in range(1, STEPS + 1):
        z, slope = np.full(len(y), bias), RIDGE * w
        if len(col):
            z[rows] += np.add.reduceat((w * scale).astype(np.float32)[col], row_starts)
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        if len(col):
            slope[cols] += np.add.reduceat(off.astype(np.float32)[row_of], col_starts) * scale[cols]
        g = np.append(slope, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score(df: DataFrame, model: tuple[np.ndarray, float], text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``df`` with the probability that each whole text is toxic; null and empty texts get the bias's.

    A column of the score's name is replaced; all others and all rows stay.
    """
    kept = [f for f in df.schema.fields if f.name.lower() != score_column.lower()]
    names = [f.name for f in kept]
    held = df.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2**BITS numbers

    def run(source):
        weights, bias = held.value
        for b in source:
            z = np.asarray([weights[features(t)].sum(dtype=np.float64) for t in b.column(b.schema.get_field_index(text_column)).to_pylist()]) + bias
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, score_column])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField(score_column, T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, eligible, label: str = "toxic", max_train: int = MAX_TRAIN, id_column: str = "doc_id", text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``documents`` with a toxicity score learnt from the eligible labels only.

    Conflicting labels of one id count as toxic; null labels and ids aren't learnt from; without
    both classes every score is the same.  Only texts are inputs of a score.
    """
    model = fit(labelled_sample(documents, labels, label, eligible, max_train, id_column, text_column))
    return score(documents, model, text_column, score_column)
