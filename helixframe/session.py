"""Session helpers: shared work folder, materialised steps, global numbering."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode (tests) and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_helixframe_dir", None)
        if base is None:
            base = spark.sparkContext._helixframe_dir = tempfile.mkdtemp(prefix="helixframe-")
    return f"{base.rstrip('/')}/helixframe-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write once to the shared folder and read back; cuts lineage in iterative operators."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame | None) -> None:
    """Delete the files behind frames that :func:`materialise` wrote, once nothing will read them again; other files stay."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        base = re.sub(r"^\w+:/*", "/", work_dir(spark))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.sub(r"^\w+:/*", "/", folder).startswith(f"{base}/"):
                p = hadoop.Path(folder)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with gapless numbers from 1 in the order of ``order``, without one task seeing all rows.

    Rows are range-partitioned and counted per partition; only the counts reach the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id())
    ranked = materialise(ranked, "ranked")  # at__ is 2^33 * partition + row of the partition
    part = F.shiftright("at__", 33)
    offsets, total = [], 0
    for r in ranked.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n")).orderBy("part__").collect():
        offsets.append((r["part__"], total))
        total += r["n"]
    before = F.broadcast(spark.createDataFrame(offsets, "part__ long, before__ long"))  # one row per partition
    number = F.col("at__").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before__") + 1
    return ranked.withColumn("part__", part).join(before, "part__").withColumn(name, number).drop("part__", "at__", "before__")
