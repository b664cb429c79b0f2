"""Structured Streaming forms: k-mer counts of arriving reads, and seeds against a static graph index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import seq as S
from ..operators.kmers import canonical_rows, kmer_rows


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Raw reads (one per line) of files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.upper("value").alias("seq"))


def running_counts(reads: DataFrame, k: int) -> DataFrame:
    """``canon, n`` as a stateful aggregate; use output mode ``update`` or ``complete``.

    Up to k = 63 the state's keys are codes, and letters are restored in what is put out.
    """
    if k <= codes.MOST_LONG_K:
        counted = canonical_rows(reads, k).groupBy(F.col("canon").alias("code")).agg(F.count(F.lit(1)).alias("n"))
        return counted.select(S.unpacked(F.col("code"), k).alias("canon"), "n")
    return kmer_rows(reads, k).groupBy(S.canonical(F.col("kmer")).alias("canon")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(reads: DataFrame, k: int, event_time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """k-mer totals per event-time window; later rows than ``late`` are dropped with their state."""
    rows = kmer_rows(reads, k, [event_time]).withWatermark(event_time, late)  # after the Arrow step, which knows no watermark
    return rows.groupBy(F.window(event_time, window).alias("window")).agg(F.count(F.lit(1)).alias("kmers"))


def live_hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Stateless lookup of arriving k-mers in a static index (a stream-static join)."""
    return canonical_rows(reads, k).select("pos", "canon").join(index, "canon")
