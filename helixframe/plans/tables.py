"""The driver's tables as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import sequence_of
from ..operators import graph, kmers
from ..session import materialise, table

K = 21


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, sf_dir, name).select(key, sequence_of(F.col("text")).alias("seq"))


def benchmark_graph(spark: SparkSession, sf_dir: str, k: int = K):
    """overlaps, nodes and arcs of the benchmark table's graph."""
    overlaps = materialise(kmers.overlap_table(sequences(spark, sf_dir, "benchmark", "item_id"), k), "overlaps")
    nodes = materialise(graph.unitigs(overlaps, k), "nodes")
    return overlaps, nodes, materialise(graph.arcs_of(nodes, overlaps, k), "arcs")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    number = F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5)
    return e.select("user_id", "ts", "event_id", (number * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)).cast("int").alias("node"))


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, chain``: each user's events in order, as signed node numbers."""
    steps = event_steps(spark, sf_dir)
    grouped = steps.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "node"))).alias("x"))
    return grouped.select("user_id", F.transform("x", lambda v: v["node"]).alias("chain"))


def chain_arcs(chains: DataFrame) -> DataFrame:
    c = F.col("chain")
    pairs = chains.filter(F.size(c) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("src"), F.element_at(c, i + 1).alias("dst")))).alias("x"))
    return pairs.select("x.src", "x.dst").distinct()


def text_of(chain: str):
    return F.array_join(F.col(chain).cast("array<string>"), " ")
