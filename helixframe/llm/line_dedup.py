"""Line deduplication across documents (operator 3).

Method: hashes of normalised lines are range-partitioned (the hash is uniform, so
equal ranges of it are balanced) and sorted inside each range by document and
position; one streaming pass keeps the first document of each hash and marks the
lines of all later ones.  What leaves the operator is a compressed keep bitmap for
each document, never text.

Skew: each task holds the smallest document it has met for a line and settles the others
on the spot, in whatever order they come, so a line that a third of all documents share
sends only a few rows per task into its range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, clash_free, lower_ascii, parts

#: Keys that a task holds for its own first documents; beyond it, it starts anew and more rows travel.
HELD_KEYS = 300_000
MIN_CHARS = 10

_LINE = pa.schema([("range_id", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32()), ("lines", pa.int32()), ("state", pa.int8())])
_CANDIDATE, _DROPPED, _DOCUMENT = 0, 1, 2


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def line_key(line: str) -> str:
    return lower_ascii(line.strip(ASCII_SPACE))


def text_mark(text: str | None) -> int:
    """Tells rows apart that carry the same document id but not the same text."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINE)], schema=_LINE)


def keep_bitmaps(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: ``doc, mark, n_lines, n_dropped, keep`` (zlib of the packed keep bits).

    A key is a line stripped of ASCII white space and ASCII-lower-cased.  Keys of at least
    ``min_chars`` code points held by two documents or more lose their lines everywhere but in
    the smallest id.  Null or empty texts are one empty line; a null id takes part as a document
    of its own below all others; rows with the same id and text give one bitmap, rows with the
    same id and different texts one each (``mark`` is a hash of the text), and they count as one
    document.  An empty table gives none.  Lines are compared by a 128-bit hash.
    """
    ranges = max(1, parts(df.sparkSession))
    width = (1 << 64) // ranges + 1

    def explode(source):
        first: dict[int, tuple[int, int, int]] = {}  # key: its smallest document, that row's mark, the line's place

        def dropped(doc, mark, pos):
            return ((doc * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) // width, 0, 0, doc, mark, pos, None, _DROPPED)

        def candidate(h, doc, mark, pos):
            high, low = h >> 64, h & 0xFFFFFFFFFFFFFFFF
            return (high // width, high - (1 << 63), low - (1 << 63), doc, mark, pos, None, _CANDIDATE)

        def flush():
            held = [candidate(h, *x) for h, x in first.items()]
            first.clear()
            for at in range(0, len(held), 10_000):
                yield _emit(held[at : at + 10_000])

        for b in source:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                doc = -(1 << 63) if doc is None else doc
                mark, lines = text_mark(text), split_lines(text)
                rows.append((xxhash.xxh3_64_intdigest(b"%d" % doc) // width, 0, 0, doc, mark, None, len(lines), _DOCUMENT))
                for pos, line in enumerate(lines):
                    if len(line) < min_chars or len(key := line_key(line)) < min_chars:
                        continue
                    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
                    known = first.setdefault(h, (doc, mark, pos))
                    if doc > known[0]:
                        rows.append(dropped(doc, mark, pos))
                    elif doc < known[0]:
                        rows.append(dropped(*known))
                        first[h] = (doc, mark, pos)
                    elif (mark, pos) != known[1:]:  # a document that repeats its own line
                        rows.append(candidate(h, doc, mark, pos))
            if rows:
                yield _emit(rows)
            if len(first) >= HELD_KEYS:
                yield from flush()
        yield from flush()

    def stream(source):
        key, owner = None, None
        for b in source:
            state = b.column(7).to_numpy(zero_copy_only=False)
            drop = state == _DROPPED
            h1, h2, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for i in np.flatnonzero(state == _CANDIDATE).tolist():
                here = (h1[i], h2[i])
                if here != key:
                    key, owner = here, doc[i]
                elif doc[i] != owner:
                    drop[i] = True
            out = drop | (state == _DOCUMENT)
            yield b.select(["doc", "mark", "pos", "lines"]).filter(pa.array(out))

    def pack(source):
        for b in source:
            n = b.column(2).to_numpy(zero_copy_only=False)
            maps, dropped = [], []
            for lines, gone in zip(n.tolist(), b.column(3).to_pylist()):
                bits = np.ones(lines, np.uint8)
                gone = list(set(gone or ()))
                bits[gone] = 0
                dropped.append(len(gone))
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "mark", "n_lines", "n_dropped", "keep"])

    lines = df.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).mapInArrow(explode, "range_id int, h1 long, h2 long, doc long, mark long, pos int, lines int, state byte")
    ranged = lines.repartitionById(ranges, "range_id").sortWithinPartitions("h1", "h2", "doc", "pos")
    marked = ranged.mapInArrow(stream, "doc long, mark long, pos int, lines int")
    grouped = marked.groupBy("doc", "mark").agg(F.max("lines").cast("long").alias("n_lines"), F.collect_list("pos").alias("gone"))
    return grouped.mapInArrow(pack, "doc long, mark long, n_lines long, n_dropped long, keep binary")


def apply_bitmap(text: str | None, keep: bytes | None) -> str:
    """The kept lines, joined by a line feed."""
    if keep is None:
        return text or ""
    lines = split_lines(text)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return text or "" if bits.all() else "\n".join([x for x, k in zip(lines, bits.tolist()) if k])


def drop_repeated_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, details: bool = False) -> DataFrame:
    """``df`` with its text rebuilt from the bitmaps; with ``details``, ``n_lines`` and ``n_dropped`` too.

    All other columns and all rows stay, but for own columns named like the details asked for.
    Nulls and repeats: see :func:`keep_bitmaps`.
    """
    extra = ["n_lines", "n_dropped"] if details else []
    fields = [f for f in df.schema.fields if f.name.lower() not in extra]
    names = [f.name for f in fields]
    df = df.select(*[f"`{n}`" for n in names])
    p = clash_free(df)
    own_mark, keep = p + "own_mark", p + "keep"

    def mark(source):
        for b in source:
            marks = pa.array([text_mark(t) for t in b.column(b.schema.get_field_index(text_column)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, marks], names=[*b.schema.names, own_mark])

    def rebuild(source):
        for b in source:
            at = {n: b.schema.get_field_index(n) for n in b.schema.names}
            texts = pa.array([apply_bitmap(t, k) for t, k in zip(b.column(at[text_column]).to_pylist(), b.column(at[keep]).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(texts if n == text_column else b.column(at[n]) for n in names), *(b.column(at[p + n]) for n in extra)], names=[*names, *extra])

    maps = keep_bitmaps(df, id_column, text_column, min_chars)
    maps = maps.select(*[F.col(n).alias(p + n) for n in maps.columns])
    marked = df.mapInArrow(mark, T.StructType([*fields, T.StructField(own_mark, T.LongType())]))
    own = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    joined = marked.join(maps, (own == F.col(p + "doc")) & (F.col(own_mark) == F.col(p + "mark")), "left").select(*[f"`{n}`" for n in names], keep, *[p + n for n in extra])
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text_column else f for f in fields), *(T.StructField(n, T.LongType()) for n in extra)])
    return joined.mapInArrow(rebuild, schema)
