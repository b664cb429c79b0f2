"""Rows in a global order: places and group starts without one task seeing all rows.

Rows are range-partitioned on the order, ties included, so that a group of equal keys may spread over
many partitions.  A pass over each sorted partition notes where its groups begin; what groups carry
over from one partition to the next is worked out from one row for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialise

MARKS = ["part__", "row__", "coarse__", "fine__", "same__"]


def _marker(coarse: int, keys: list[str]):
    """A pass over sorted batches: each row's number in the partition, where its groups begin there, and whether the next row is of its group."""

    def mark(source):
        from pyspark import TaskContext

        part, base, held, starts = TaskContext.get().partitionId(), 0, None, [0, 0]
        for b in source:
            if not b.num_rows:
                continue
            if held is not None:  # the last row of the batch before, whose next row is known only now
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            values = [np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.int64) for c in keys]
            row, found = base + np.arange(b.num_rows), []
            for i, n in enumerate((coarse, len(keys))):
                new = np.zeros(b.num_rows, bool)
                for v in values[:n]:
                    new[1:] |= v[1:] != v[:-1]
                found.append(np.maximum.accumulate(np.where(new, row, starts[i])))
            yield _marked(b, part, row, found, ~new[1:], b.num_rows - 1)
            held, base, starts = b.slice(b.num_rows - 1), base + b.num_rows - 1, [int(c[-1]) for c in found]
        if held is not None:
            yield _marked(held, part, np.array([base]), [np.array([s]) for s in starts], np.array([False]), 1)

    return mark


def _marked(b: pa.RecordBatch, part: int, row, found, same, n: int) -> pa.RecordBatch:
    columns = [pa.array(np.full(n, part, np.int32)), *(pa.array(np.asarray(c[:n], np.int64)) for c in (row, *found)), pa.array(same[:n])]
    return pa.RecordBatch.from_arrays([*b.slice(0, n).columns, *columns], names=[*b.schema.names, *MARKS])


def with_places(df: DataFrame, coarse: list[str], fine: list[str], ties: list[str], name: str = "placed") -> DataFrame:
    """``df`` with ``place`` (from 0), ``coarse_start``, ``fine_start`` and ``alone``, written to the scratch folder.

    The order is ``coarse, fine, ties``: whole numbers without nulls.  The starts are the places where
    the row's group of equal ``coarse``, and of equal ``coarse`` and ``fine``, begins; ``alone``: no
    other row has the same of both.
    """
    spark = df.sparkSession
    keys = [*coarse, *fine]
    order = [*keys, *ties]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, kind) for c, kind in zip(MARKS, kinds))])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_marker(len(coarse), keys), schema), name)
    last = F.struct("row__", *keys, "coarse__", "fine__")
    ends = marked.groupBy("part__").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row__", *keys)).alias("first"), F.max(last).alias("last")).collect()  # a row for each partition
    carried, offset, above, goes_on = [], 0, None, {}
    for r in sorted(ends, key=lambda r: r["part__"]):
        own = [tuple(r["first"][c] for c in part) for part in (coarse, keys)]
        starts = [offset, offset]
        if above is not None:
            starts = [above["starts"][i] if own[i] == above["keys"][i] else offset for i in (0, 1)]
            goes_on[above["part"]] = own[1] == above["keys"][1]
        carried.append((r["part__"], offset, *starts))
        ending = [starts[i] if r["last"][c] == 0 else offset + r["last"][c] for i, c in enumerate(("coarse__", "fine__"))]
        above = {"part": r["part__"], "starts": ending, "keys": [tuple(r["last"][c] for c in part) for part in (coarse, keys)]}
        offset += r["n"]
    rows = [(*c, bool(goes_on.get(c[0], False)), next(r["n"] for r in ends if r["part__"] == c[0])) for c in carried]
    known = F.broadcast(spark.createDataFrame(rows, "part__ int, offset__ long, coarse_at__ long, fine_at__ long, goes_on__ boolean, n__ long"))
    start = lambda c: F.when(F.col(f"{c}__") == 0, F.col(f"{c}_at__")).otherwise(F.col(f"{c}__") + F.col("offset__"))
    both = marked.join(known, "part__")
    place = F.col("row__") + F.col("offset__")
    same = F.col("same__") | (F.col("goes_on__") & (F.col("row__") == F.col("n__") - 1))
    return both.select(*df.columns, place.alias("place"), start("coarse").alias("coarse_start"), start("fine").alias("fine_start"), ((start("fine") == place) & ~same).alias("alone"))


__all__ = ["discard", "with_places"]
