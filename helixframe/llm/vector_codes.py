"""Product codes of vectors by delta-maintained Lloyd rounds (operator 11).

A vector's whole-number components are cut into equal parts, and every part position has a
codebook of at most 256 entries.  A round assigns each part to its nearest entry and moves every
entry to the mean of its parts.  What a round knows of the vectors is kept in one table: each
row's assignments stand beside its components, and each entry's running sums and count are whole
numbers.  A round reads that table, writes it anew with the new assignments, and its tasks add up
``+`` for the entry that a changed part joins and ``-`` for the one it leaves; only these sums are
shuffled.  Parts that keep their entry send nothing.

Defined results: rows whose vector is null or holds null or non-finite components are left out.
Shorter vectors count as if they ended in zeros, and so does a width that the number of parts
doesn't divide; an empty vector is all zeros.  Repeated rows and repeated ids each count; of rows
with one id the one of the smaller vector comes first, and null ids come last.  Fewer rows than
entries give a smaller codebook, no row an empty one.  Components whose squared distances could
leave 64 bits stop at the largest that can't (:func:`limit`, 2^27.5 or 189,812.5 unscaled for 64
components); error sums beyond 64 bits stop at 2^63 - 1.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clash_free, drop_stored, stored, tuned

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: A label's sum goes out this many times, so that rows of a frequent label are joined in so many tasks.
LABEL_SALTS = 16
MOST = 2**63 - 1


def limit(width: int) -> int:
    """Largest component for which a vector's squared distances, and every sum on the way to them, fit 64 bits."""
    return math.isqrt(MOST // (4 * max(width, 1)))


def usable(df: DataFrame, vector: str) -> DataFrame:
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(math.inf))
    return df.filter(F.col(vector).isNotNull() & ~F.exists(F.col(vector), bad))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components, zeros at the end of shorter ones."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    most = limit(x.shape[1])
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, ties to the lower index, and the squared distance; exact."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    large = max(int(np.abs(x).max()), int(np.abs(entries).max()))
    if 4 * large * large * x.shape[1] < 2**53:  # every term is whole and fits a double
        far = (entries.astype(np.float64) ** 2).sum(1) - 2 * (x.astype(np.float64) @ entries.T.astype(np.float64))
        at = far.argmin(1)
    else:
        at, low = np.zeros(len(x), np.int64), np.full(len(x), MOST)
        for i, e in enumerate(entries):
            d = ((x - e) ** 2).sum(1)
            less = d < low
            at[less], low[less] = i, d[less]
    return at, ((x - entries[at]) ** 2).sum(1)


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows by parts) and each row's squared distances summed over its parts."""
    size = books.shape[2]
    codes, error = np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        codes[:, p], d = nearest(x[:, p * size : (p + 1) * size], book)
        error += d
    return codes, error


def _packed(matrix: np.ndarray, kind: str) -> pa.Array:
    data = np.ascontiguousarray(matrix.astype(kind))
    step = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * step).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).astype(np.int64)


STATE = "id long, label int, v binary, codes binary, slot int, change array<long>"


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, trace: list | None = None) -> tuple[DataFrame, np.ndarray]:
    """``id, label, codes, error`` of every usable row, and the final codebooks (parts by entries by components).

    ``codes`` holds a byte for each part.  ``trace`` is given each round's number of changed parts.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256: a code is a byte")
    spark = tuned(df.sparkSession)
    tag = F.col(label).cast("int") if label else F.lit(None).cast("int")
    kept = usable(df, vector).select(F.col(id_column).cast("long").alias("id"), tag.alias("label"), F.col(vector).cast("array<double>").alias("x"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()  # at most 256 vectors
    width = int(kept.agg(F.max(F.size("x")).alias("n")).first()["n"] or 0)
    width += -width % parts
    size = width // parts
    start = _whole(_rows(first.column("x").combine_chunks(), width), scale) if first.num_rows else np.zeros((0, width), np.int64)
    books = np.stack([start[:, p * size : (p + 1) * size] for p in range(parts)])
    n = books.shape[1]
    sums, counts = [[[0] * size for _ in range(n)] for _ in range(parts)], [[0] * n for _ in range(parts)]
    if not n:
        return spark.createDataFrame([], "id long, label int, codes binary, error long"), books

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        if "x" in batch.schema.names:
            return _whole(_rows(batch.column("x"), width), scale)
        return _unpacked(batch.column("v"), width, "<i4")

    def round_of(sent):
        def run(source):
            """Every row with its new assignments; then a row for each entry whose parts changed: its change in count and sums."""
            change = np.zeros((parts, n, size + 2), np.int64)  # count, parts that joined, sums
            for batch in source:
                if not batch.num_rows:
                    continue
                x = vectors(batch)
                codes, _ = _assign(x, sent.value)
                before = _unpacked(batch.column("codes"), parts, "u1") if "codes" in batch.schema.names else np.full(codes.shape, -1)
                for p in range(parts):
                    moved = codes[:, p] != before[:, p]
                    own = np.column_stack([np.ones((int(moved.sum()), 2), np.int64), x[moved, p * size : (p + 1) * size]])
                    np.add.at(change[p], codes[moved, p], own)
                    own[:, 1] = 0
                    old = before[moved, p]
                    np.subtract.at(change[p], old[old >= 0], own[old >= 0])
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _packed(x, "<i4"), _packed(codes, "u1"), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))], names=["id", "label", "v", "codes", "slot", "change"])
            flat = change.reshape(parts * n, size + 2)
            at = np.flatnonzero(flat.any(axis=1))
            if len(at):
                nothing = lambda kind: pa.nulls(len(at), kind)
                yield pa.RecordBatch.from_arrays([nothing(pa.int64()), nothing(pa.int32()), nothing(pa.binary()), nothing(pa.binary()), pa.array(at, pa.int32()), pa.array(flat[at].tolist(), pa.list_(pa.int64()))], names=["id", "label", "v", "codes", "slot", "change"])

        return run

    state, rows = None, kept
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)  # parts * entries * components of a part
        new = stored(rows.mapInArrow(round_of(sent), STATE), "codes")
        if state is not None:
            drop_stored(state)
        state, rows = new, new.filter(F.col("slot").isNull()).select("id", "label", "v", "codes")
        each = new.filter(F.col("slot").isNotNull()).select("slot", F.posexplode("change").alias("at", "by")).filter(F.col("by") != 0)
        total = each.groupBy("slot", "at").agg(F.sum(F.col("by").cast("decimal(38,0)")).alias("by")).toArrow().to_pylist()  # a number for each component of the codebooks
        for r in total:
            p, e = divmod(r["slot"], n)
            if r["at"] > 1:
                sums[p][e][r["at"] - 2] += int(r["by"])
            elif r["at"] == 0:
                counts[p][e] += int(r["by"])
        if trace is not None:
            trace.append(sum(int(r["by"]) for r in total if r["at"] == 1))
        books = np.array([[[s // counts[p][e] for s in sums[p][e]] if counts[p][e] else books[p, e].tolist() for e in range(n)] for p in range(parts)], np.int64).reshape(parts, n, size)

    sent = spark.sparkContext.broadcast(books)

    def finish(source):
        for batch in source:
            if batch.num_rows:
                codes, error = _assign(vectors(batch), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _packed(codes, "u1"), pa.array(error)], names=["id", "label", "codes", "error"])

    coded = stored(rows.mapInArrow(finish, "id long, label int, codes binary, error long"), "coded")
    if state is not None:
        drop_stored(state)
    return coded, books


def with_label_error(coded: DataFrame, error: str = "error", label: str = "label") -> DataFrame:
    """``coded`` and ``label_error``: the errors' sum over all rows of the same label, nulls together.

    Sums are added up before the shuffle; each goes out once for every salt, so that a label that
    many rows bear is joined in many tasks.
    """
    h = clash_free(coded)
    total = F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col(label).alias(f"{h}label")).agg(total.alias("label_error"))
    sums = sums.withColumn(f"{h}salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    salted = coded.withColumn(f"{h}own", F.pmod(F.monotonically_increasing_id(), F.lit(LABEL_SALTS)).cast("int"))
    same = salted[label].eqNullSafe(sums[f"{h}label"]) & (salted[f"{h}own"] == sums[f"{h}salt"])
    return salted.join(sums, same).select(*coded.columns, "label_error")


def codebooks_sha256(books: np.ndarray) -> str:
    """Hash of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` and ``v``: the vector that a code stands for, as whole numbers."""
    sent = coded.sparkSession.sparkContext.broadcast(books)
    names = coded.columns

    def run(source):
        for batch in source:
            if batch.num_rows:
                codes = _unpacked(batch.column("codes"), len(sent.value), "u1")
                v = np.concatenate([book[codes[:, p]] for p, book in enumerate(sent.value)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v.tolist(), pa.list_(pa.int64()))], names=[*names, "v"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("v", T.ArrayType(T.LongType()))]))
