"""Records of text files, found inside file splits.

Spark's text scan cuts files into splits and gives every split its whole lines.  A pass over them
finds where records begin, so whole records never leave their split; no line is shuffled.  Only the lines
before a split's first record and those of its last, unended one (a few for each split) are put together with their
neighbours'.  Records are numbered without gaps in the order of file names and places: a first pass
counts the records of each split, and only these counts reach the driver.

The formats differ in a small cutter: ``starts`` says whether a record begins at a line, seen with
the ``ahead`` lines that follow; ``size`` is a record's number of lines, None where only the next
record ends one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Bytes of lines that a task's Python holds as strings at once.
PIECE_BYTES = 4 << 20

FIELDS = ("head", "read", "plus", "qual")


class Fasta:
    """A record begins at ``>`` and ends before the next; its lines are joined.  What precedes the first is skipped."""

    ahead, size = 0, None

    @staticmethod
    def starts(lines: list[str], at: int) -> bool:
        return lines[at].startswith(">")

    @staticmethod
    def records(lines: list[str]):
        held = None
        for line in lines:
            if line.startswith(">"):
                if held is not None:
                    yield held[0], "".join(held[1:]), None, None
                held = [line]
            elif held is not None:
                held.append(line.strip(" ").replace("\r", ""))
        if held is not None:
            yield held[0], "".join(held[1:]), None, None


class Fastq:
    """Four lines a record.  A header begins with ``@``, and two lines further there is a ``+``; a sequence begins with neither."""

    ahead, size = 2, 4

    @staticmethod
    def starts(lines: list[str], at: int) -> bool:
        return lines[at].startswith("@") and lines[at + 2].startswith("+")

    @staticmethod
    def records(lines: list[str]):
        for at in range(0, len(lines), 4):
            four = (lines[at : at + 4] + [""] * 3)[:4]
            if four[0] and not four[0].startswith("@"):
                raise ValueError(f"FASTQ header must start with @: {four[0]}")
            yield tuple(four)


class Lines:
    """A record a line."""

    ahead, size = 0, 1

    @staticmethod
    def starts(lines: list[str], at: int) -> bool:
        return True

    @staticmethod
    def records(lines: list[str]):
        for line in lines:
            yield line, None, None, None


CUTTERS = {"fasta": Fasta, "fastq": Fastq, "raw": Lines, "sam": Lines}


class _Split:
    """One split's lines as they come: those before its first record, whole records, and the last, unended one."""

    def __init__(self, cutter, first: bool):
        self.cutter, self.head, self.open, self.found = cutter, [], [], first and cutter.size is not None
        self.number = 0

    def add(self, lines: list[str]):
        """Line lists of the whole records that end with these lines."""
        if not self.found:
            self.head += lines
            last = len(self.head) - self.cutter.ahead
            at = next((i for i in range(max(0, last - len(lines)), last) if self.cutter.starts(self.head, i)), None)
            if at is None:
                return
            self.found, lines, self.head = True, self.head[at:], self.head[:at]
        if self.cutter.size is None:
            for line in lines:
                if line.startswith(">") and self.open:
                    yield self.open
                    self.open = []
                    self.number += 1
                self.open.append(line)
        else:
            size = self.cutter.size
            both = self.open + lines
            whole = len(both) - len(both) % size
            self.number += whole // size
            self.open = both[whole:]
            if whole:
                yield both[:whole]


def _pieces(source):
    """Slices of batches that hold about ``PIECE_BYTES`` of lines, so that Python's copies don't grow with a batch."""
    for b in source:
        sizes = pa.compute.binary_length(b.column(b.schema.get_field_index("value"))).fill_null(0)
        held = np.cumsum(np.asarray(sizes, np.int64)) // PIECE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), b.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield b.slice(low, high - low)


def _splits(source, cutter):
    """(file, start, split, records' lines) for each piece of lines of each split."""
    now, key = None, None
    for b in _pieces(source):
        files, starts, lines = (b.column(c).to_pylist() for c in ("file", "start", "value"))
        at = 0
        while at < len(lines):
            end = at
            if files[at] == files[-1] and starts[at] == starts[-1]:
                end = len(lines)
            else:
                while end < len(lines) and files[end] == files[at] and starts[end] == starts[at]:
                    end += 1
            if (files[at], starts[at]) != key:
                if key is not None:
                    yield key, now, None
                key, now = (files[at], starts[at]), _Split(cutter, starts[at] == 0)
            for whole in now.add(lines[at:end]):
                yield key, now, whole
            at = end
    if key is not None:
        yield key, now, None


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))


def _numbered_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Records of a line each, numbered without Python: a split's lines are in one task and in order, so its first number and its count place them all."""
    placed = lines.withColumn("id__", F.monotonically_increasing_id())
    known = placed.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id__").alias("first"))
    offsets, total = [], 0
    for r in sorted(known.collect(), key=lambda r: (r["file"], r["start"])):  # a row for each split
        offsets.append((r["file"], r["start"], total - r["first"]))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(offsets, "file string, start long, offset long"))
    none = F.lit(None).cast("string")
    return placed.join(before, ["file", "start"]).select((F.col("offset") + F.col("id__")).alias("rec_id"), F.col("value").alias("head"), none.alias("read"), none.alias("plus"), none.alias("qual"))


def scan(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``rec_id, head, read, plus, qual`` of a file's or folder's records, numbered from 0 by file name and place.

    Null where a format has no such field; ``head`` is the whole line of formats of a line a record.
    The result is the same however the files are split.
    """
    cutter = CUTTERS[kind]
    lines = _scan(spark, path)
    if cutter is Lines:
        return _numbered_lines(spark, lines)

    def summarise(source):
        for (file, start), split, whole in _splits(source, cutter):
            if whole is None:
                yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "n": split.number, "found": split.found, "head": split.head, "tail": split.open}], schema=_SUMMARY)

    known = materialise(lines.mapInArrow(summarise, "file string, start long, n long, found boolean, head array<string>, tail array<string>"), "splits")
    pieces = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).alias("new"), F.col("head").alias("lines")), F.struct(F.lit(1).alias("side"), F.col("found").cast("int").alias("new"), F.col("tail").alias("lines")))
    each = known.select("file", "start", "n", F.explode(pieces).alias("x")).select("file", "start", "n", "x.*")
    w = Window.partitionBy("file").orderBy("start", "side")
    runs = each.withColumn("run", F.sum("new").over(w)).filter("run > 0")  # what precedes a file's first record is none
    joined = runs.groupBy("file", "run").agg(F.min(F.when(F.col("new") == 1, F.struct("start", "n"))).alias("x"), F.array_sort(F.collect_list(F.struct("start", "side", "lines"))).alias("p"))
    joined = joined.select("file", F.col("x.start").alias("start"), F.col("x.n").alias("first"), F.flatten(F.transform("p", lambda v: v["lines"])).alias("lines")).filter(F.size("lines") > 0)

    def cut(source):
        for b in source:
            for file, start, first, held in zip(*(b.column(c).to_pylist() for c in ("file", "start", "first", "lines"))):
                yield _rows(file, start, first, list(cutter.records(held)))

    stitched = materialise(joined.mapInArrow(cut, _ROWS), "stitched")
    more = {(r["file"], r["start"]): r["n"] for r in stitched.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for r in sorted(known.select("file", "start", "n").collect(), key=lambda r: (r["file"], r["start"])):  # a row for each split
        offsets.append((r["file"], r["start"], total))
        total += r["n"] + more.get((r["file"], r["start"]), 0)
    before = F.broadcast(spark.createDataFrame(offsets, "file string, start long, offset long"))

    def whole(source):
        done, last = 0, None
        for key, _, records in _splits(source, cutter):
            if key != last:
                done, last = 0, key
            if records is not None:
                rows = list(cutter.records(records))
                yield _rows(*key, done, rows)
                done += len(rows)

    found = lines.mapInArrow(whole, _ROWS).unionByName(stitched)
    return found.join(before, ["file", "start"]).select((F.col("offset") + F.col("at")).alias("rec_id"), *FIELDS)


_ROWS = "file string, start long, at long, head string, read string, plus string, qual string"
_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("found", pa.bool_()), ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string()))])


def _rows(file: str, start: int, first: int, records: list) -> pa.RecordBatch:
    n = len(records)
    columns = list(zip(*records)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], names=["file", "start", "at", *FIELDS])
