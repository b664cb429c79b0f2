"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = "\t\n\x0b\x0c\r "
#: Rows and bytes of one Arrow batch handed to Python; keeps long documents from piling up in a worker.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def tuned(spark: SparkSession) -> SparkSession:
    """Session with Arrow batches small enough for very long texts."""
    for key, value in ARROW_CONF.items():
        with contextlib.suppress(Exception):  # a setting this Spark version does not know
            spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: the session's ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (tests) a temporary folder is made; on a
    cluster without it, a ValueError is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        holder = spark.sparkContext
        if not re.match(r"local(\[|$)", holder.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(holder, "_helixframe_dir", None)
        if base is None:
            base = holder._helixframe_dir = tempfile.mkdtemp(prefix="helixframe-")
    return f"{base.rstrip('/')}/helixframe-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that :func:`stored` wrote and nothing has dropped yet, by application.
_made: dict[str, set[str]] = {}


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a frame read from one or more :func:`stored` ones, once nothing will read it again."""
    spark = df.sparkSession
    made = _made.get(spark.sparkContext.applicationId, set())
    files = [f.rsplit("/", 1)[0] for f in df.inputFiles()]
    for path in [p for p in made if any(f.endswith(p.rsplit("/", 1)[1]) for f in files)]:
        _delete(spark, path)


def drop_all_stored(spark: SparkSession) -> None:
    """Delete what :func:`stored` left behind; for pipelines, whose stages' results are tables of their own."""
    for path in list(_made.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)
    release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[spark.sparkContext.applicationId].discard(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of jobs whose frames are gone, and give the driver's free memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str) -> int:
    row = df.agg(F.sum(F.octet_length(F.col(column)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def lower_ascii(text: str) -> str:
    """A-Z to a-z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the ASCII-lower-cased text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def clash_free(df: DataFrame, *wanted: str) -> str:
    """Prefix that no column of ``df`` starts with, for helper columns."""
    names = {c.lower() for c in df.columns}
    prefix = "_h"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix
