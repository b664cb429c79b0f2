"""Document fingerprints: bottom-k sketches of shingle hashes (operator 10).

A sketch is the k smallest distinct hashes of a text's shingles, in ascending order,
packed as big-endian 64-bit numbers.  Sketches of parts merge into the sketch of the
whole, and two sketches estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, words_of
from .jaccard_join import mix, shingles

K = 128
SHINGLE_WORDS = 5
SHINGLE_BYTES = 5


def sketch(text: str | None, k: int = K, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The k smallest shingle hashes.  Texts of fewer words than a shingle use byte shingles instead."""
    found = words_of(text)
    if len(found) >= words:
        return shingles(text, words)[:k]
    raw = b" ".join(found)
    grams = {raw[i : i + SHINGLE_BYTES] for i in range(max(1, len(raw) - SHINGLE_BYTES + 1))} if raw else ()
    return np.sort(mix(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams))))[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, np.uint64)


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[k - 1]) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest hashes of the union that both hold; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    union = distinct(merge(a, b, k=k), k)
    return min(1.0, r * union / max(1.0, distinct(a, k)))


def to_bytes(s: np.ndarray) -> bytes:
    return s.astype(">u8").tobytes()


def from_bytes(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """``doc_id, n_chars, sketch (binary), n_distinct`` per row; null and empty texts have an empty sketch."""

    def run(source):
        for b in source:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = [sketch(t, k) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_bytes(s) for s in made], pa.binary()), pa.array([distinct(s, k) for s in made], pa.float64())], names=["doc_id", "n_chars", "sketch", "n_distinct"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_chars long, sketch binary, n_distinct double")


def merge_sketches(df: DataFrame, group_column: str, sketch_column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """``group, sketch, n_distinct``: one sketch per group; a large group merges in salted parts first."""

    def run(source):
        held: dict = {}
        for b in source:
            for g, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[g] = merge(held[g], from_bytes(raw), k=k) if g in held else from_bytes(raw)
            if len(held) > 20_000:
                yield _groups(held, k)
                held = {}
        if held:
            yield _groups(held, k)

    group = df.select(F.col(group_column).alias("group"), F.col(sketch_column).alias("sketch"))
    schema = f"group {dict(df.dtypes)[group_column]}, sketch binary"
    first = group.mapInArrow(run, schema)
    salted = first.repartition("group", F.pmod(F.xxhash64("sketch"), F.lit(salts))).mapInArrow(run, schema)

    def last(table: pa.Table) -> pa.Table:
        s = merge(*(from_bytes(x) for x in table.column(1).to_pylist()), k=k)
        return pa.table({"group": table.column(0).slice(0, 1), "sketch": pa.array([to_bytes(s)], pa.binary()), "n_distinct": pa.array([distinct(s, k)], pa.float64())})

    return salted.groupBy("group").applyInArrow(last, schema + ", n_distinct double")


def _groups(held: dict, k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([to_bytes(s) for s in held.values()], pa.binary())], names=["group", "sketch"])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def with_next(df: DataFrame, run, schema: str, id_column: str = "doc_id", text_column: str = "text", ranges: int | None = None) -> DataFrame:
    """Apply ``run(rows)`` to an iterator of (id, text, next text) in ascending id; the last is followed by the first.

    Ids are cut at quantiles into as many ranges as the session has shuffle partitions; each range also
    gets the first row of the next range, so one shuffle of the texts is enough and no task sees more
    than its range.  Rows with the same id follow each other by text; null ids come first.
    """
    spark = df.sparkSession
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    keys = df.select(key.alias("key"))
    ranges = ranges or parts(spark)
    bounds = sorted(set(keys.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    bounds = [int(b) for b in bounds]

    def number(source):
        for b in source:
            at = np.searchsorted(np.asarray(bounds, np.int64), b.column(0).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0)], names=["range_id", "key"])

    first = {r["range_id"]: r["key"] for r in keys.mapInArrow(number, "range_id int, key long").groupBy("range_id").agg(F.min("key").alias("key")).collect()}  # a row per range
    order = sorted(first)
    before = {first[r]: order[i - 1] for i, r in enumerate(order)}  # the range that a first key must follow too

    def deal(source):
        for b in source:
            k = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(np.asarray(bounds, np.int64), k, side="right").astype(np.int32)
            extra = [i for i, x in enumerate(k.tolist()) if x in before]
            rows = pa.array(np.concatenate([np.arange(len(k)), extra]).astype(np.int64))
            where = np.concatenate([at, [before[int(k[i])] for i in extra]]).astype(np.int32)
            follow = np.concatenate([np.zeros(len(k)), np.ones(len(extra))]).astype(np.int8)
            out = b.take(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(follow), *out.columns], names=["range_id", "follow", *out.schema.names])

    def stream(source):
        def rows():
            held = None
            for b in source:
                for r, follow, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    if held and held[0] == r:
                        yield held[1], held[2], text or ""
                    held = (r, doc, text or "") if not follow else None

        yield from run(rows())

    base = df.select(key.alias("key"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    dealt = base.mapInArrow(deal, "range_id int, follow byte, key long, doc_id long, text string")
    return dealt.repartitionById(ranges, "range_id").sortWithinPartitions("range_id", "follow", "key", "text").mapInArrow(stream, schema)


def fingerprint_edits(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """Each text's sketch, its edited text (see :func:`edited_text`), that text's sketch and both likenesses.

    ``doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next, contained, n_distinct``.
    Null and empty texts have empty sketches; two empty sketches have likeness 1.  A lone row is
    followed by itself.
    """

    def run(rows):
        held = []
        own_text, own = None, None
        for doc, text, following in rows:
            s = own if text == own_text else sketch(text, k)
            nxt = sketch(following, k)
            own_text, own = following, nxt
            edited = edited_text(text, following)
            e = sketch(edited, k)
            held.append((doc, len(text), edited, to_bytes(s), to_bytes(e), resemblance(s, e, k), resemblance(s, nxt, k), containment(s, e, k), distinct(s, k)))
            if len(held) >= 500:
                yield _edits(held)
                held = []
        if held:
            yield _edits(held)

    return with_next(df, run, "doc_id long, n_chars long, edited string, sketch binary, edited_sketch binary, near_edited double, near_next double, contained double, n_distinct double", id_column, text_column)


def _edits(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next", "contained", "n_distinct"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
