"""The commands as jobs: index, align, compare, SAM conversion; stages are skipped where their tables exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import evaluate, extend, graph, kmers, markov
from ..session import materialise
from ..sources import reads as sources
from ..sources import sinks


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def build_graph(sequences: DataFrame, k: int, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of a table with a column ``seq`` (stages 1 and 2)."""
    overlaps = materialise(kmers.overlap_table(sequences, k, least), "overlaps")
    nodes = materialise(graph.unitigs(overlaps, k), "nodes")
    return nodes, materialise(graph.arcs_of(nodes, overlaps, k), "arcs")


def input_sequences(spark: SparkSession, paths: list[str], keep: list[str] | None = None) -> DataFrame:
    """``seq`` (and columns to keep) of all libraries, in capitals."""
    return sources.read_libraries(spark, paths).select(*(keep or []), F.upper("read").alias("seq"))


def index(spark: SparkSession, settings: Settings) -> str:
    """``index``: read the inputs, write the graph below the work path; an existing graph is kept."""
    out = f"{settings.work_path}/graph"
    if not _exists(spark, f"{out}/meta"):
        reads = input_sequences(spark, [p for p, _ in settings.inputs])
        nodes, arcs = build_graph(reads, settings.k, settings.abundance_min)
        sinks.save_graph(nodes, arcs, out)
    return out


def align_table(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, settings: Settings) -> DataFrame:
    """Both passes on a table ``rec_id, seq``."""
    k = settings.k
    first = materialise(extend.align_pass1(reads, nodes, arcs, k, settings.mem_seeds, settings.branch_and_bound, settings.search_depth), "pass1")
    if not settings.markov_filter:
        return first
    stats = first.filter(F.length("seq") >= k).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("seq")).alias("l")).first()
    size = nodes.agg(F.sum("marg_len").alias("s")).first()["s"] or 0
    cover = markov.estimated_coverage(stats["n"], size, stats["l"] or 0.0)
    table = markov.train(first.filter("aligned").select("chain"), nodes, arcs, k, cover, stats["l"] or 0.0)
    return extend.align_pass2(first, nodes, arcs, k, table, settings.branch_and_bound, settings.search_depth, settings.mem_seeds)


def align(spark: SparkSession, settings: Settings) -> DataFrame:
    """``align``: reads against the saved graph; writes corrected reads and alignment lines of each library."""
    nodes, arcs = sinks.load_graph(spark, f"{settings.work_path}/graph", settings.k)
    out = None
    for i, (path, target) in enumerate(settings.inputs):
        library = sources.read_library(spark, path, i)
        found = materialise(align_table(library.select("rec_id", F.upper("read").alias("seq")), nodes, arcs, settings), "aligned")
        target = target or f"{path}.corr"
        done = library.join(found.select("rec_id", "corrected"), "rec_id").withColumn("read", F.col("corrected"))
        sinks.write_reads(done, target)
        lines = library.select("rec_id", F.regexp_replace(F.trim("pre"), r"\n", "").alias("header")).join(extend.with_info(found).select("rec_id", "info"), "rec_id")
        sinks.write_alignments(lines, f"{target}.ncf")
        sinks.write_metrics(extend.alignment_metrics(found, settings.k), f"{target}.sta")
        out = found if out is None else out.unionByName(found)
    return out


def compare(spark: SparkSession, wrong: str, perfect: str, corrected: str) -> DataFrame:
    return evaluate.evaluate(*(sources.read_library(spark, p) for p in (wrong, perfect, corrected)))


def sam_to_alignment(spark: SparkSession, sam: str, genome: str, reads: str, allowed: str = "MIDS", use_alternatives: bool = False) -> DataFrame:
    return evaluate.sam_to_reads(sources.read_library(spark, reads), sources.read_sam(spark, sam), sources.read_contigs(spark, genome), allowed, use_alternatives)
