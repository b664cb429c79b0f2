"""Sinks: reads, graphs, alignments, Markov tables, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chain_of, tag
from ..operators import kmers

FASTA_WIDTH = 70


def wrapped(seq: Column, width: int = FASTA_WIDTH) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: seq.substr(i, F.lit(width))), "\n")


def write_fasta(reads: DataFrame, path: str, width: int = FASTA_WIDTH) -> None:
    lines = F.concat(F.regexp_replace(F.rtrim("pre"), r"\n$", ""), F.lit("\n"), wrapped(F.col("read"), width))
    _ordered(reads).select(lines.alias("value")).write.text(path)


def write_reads(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """Every record as it was read: what precedes the read, the read, what follows."""
    out = F.regexp_replace(F.concat("pre", "read", "post"), r"\n$", "")
    _ordered(reads).select(out.alias("value")).write.option("compression", compression or "none").text(path)


def _ordered(reads: DataFrame) -> DataFrame:
    return reads.sort(*[c for c in ("lib_id", "rec_id") if c in reads.columns])


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.json(path)  # one row per library


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_kmers(table: DataFrame, path: str) -> None:
    table.write.parquet(path)


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    """Nodes, arcs and their numbers as three tables (stages 2 and 3)."""
    nodes.write.parquet(f"{path}/nodes")
    arcs.write.parquet(f"{path}/arcs")
    spark = nodes.sparkSession
    spark.createDataFrame([(spark.read.parquet(f"{path}/nodes").count(), spark.read.parquet(f"{path}/arcs").count())], "nodes long, arcs long").write.json(f"{path}/meta")


def load_graph(spark: SparkSession, path: str, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The saved graph; with k, every arc's target is found anew from the nodes' ends.

    An arc is its source and a base: its target is the node that begins with the source's last k - 1 bases and it.  An arc
    that leads elsewhere or nowhere, one without its counterpart on the other strand, or a changed
    number of rows is an error.
    """
    nodes, arcs = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/arcs")
    meta = spark.read.json(f"{path}/meta").first()
    if (nodes.count(), arcs.count()) != (meta["nodes"], meta["arcs"]):
        raise ValueError("the graph's files don't match its meta data")
    if k:
        from ..operators.graph import asymmetric_arcs, rebuilt_arcs

        arcs = rebuilt_arcs(nodes, arcs, k)
        wrong = arcs.filter(F.col("found").isNull() | (F.col("found") != F.col("dst"))).limit(1).collect()
        if wrong:
            raise ValueError(f"the arc {wrong[0]['src']} -> {wrong[0]['dst']} doesn't follow from the nodes' ends")
        arcs = arcs.drop("found")
        if not asymmetric_arcs(arcs).isEmpty():
            raise ValueError("an arc lacks its counterpart on the other strand")
    return nodes, arcs


def node_text(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat_ws("\n", F.concat_ws("\t", F.lit("NODE"), "node_id", "marg_len", "kmer_cov", "read_start_cov"), "seq").alias("value"))


def arc_text(arcs: DataFrame) -> DataFrame:
    """One line a node: left and right neighbour masks and the arcs' coverages in the order of the bases."""
    return arcs.groupBy(F.abs("src").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "base", "cov"))), lambda x: x["cov"].cast("string")), "\t").alias("covs"), F.count(F.lit(1)).alias("n")).select(F.concat_ws("\t", "node_id", "n", "covs").alias("value"))


def fasta_graph(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """FASTA of the nodes with their left and right neighbours in the header."""
    right = arcs.filter("src > 0").groupBy(F.col("src").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list("dst")).cast("array<string>"), " ").alias("r"))
    left = arcs.filter("src < 0").groupBy((-F.col("src")).alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(-F.col("dst"))).cast("array<string>"), " ").alias("l"))
    joined = nodes.join(left, "node_id", "left").join(right, "node_id", "left")
    return joined.select(F.concat(F.lit(">NODE "), "node_id", F.lit(" "), F.length("seq"), F.lit(" L("), F.coalesce("l", F.lit("")), F.lit(") R("), F.coalesce("r", F.lit("")), F.lit(")\n"), wrapped(F.col("seq"))).alias("value"))


def write_cytoscape(nodes: DataFrame, arcs: DataFrame, path: str, seeds: DataFrame | None = None, depth: int = 0) -> None:
    """Tab-separated ``.arcs`` and ``.nodes``: the whole graph, or what seeds reach within ``depth`` arcs."""
    if seeds is not None:
        from ..operators.graph import neighbourhood

        near = neighbourhood(arcs, seeds, depth).select("node").distinct()
        arcs = arcs.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
        nodes = nodes.join(near.select(F.abs("node").cast("int").alias("node_id")).distinct(), "node_id", "left_semi")
    arcs.select("src", "dst", "cov").write.csv(f"{path}.arcs", sep="\t", header=True)
    nodes.select("node_id", "marg_len", "kmer_cov", "seq").write.csv(f"{path}.nodes", sep="\t", header=True)


def write_alignments(alignments: DataFrame, path: str) -> None:
    """One line a read: header and alignment tags (the .ncf file)."""
    alignments.sort("rec_id").select(F.concat_ws("\t", "header", "info").alias("value")).write.text(path)


def parse_alignments(lines: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    pos = F.split(tag(v, "P"), " ")
    return lines.select(F.split(v, "\t")[0].alias("header"), (tag(v, "A") == "1").alias("aligned"), tag(v, "S").cast("int").alias("score"), (tag(v, "B") == "1").alias("branch"), pos[0].cast("int").alias("pos_first"), F.get(pos, F.lit(1)).cast("int").alias("pos_last"), chain_of(tag(v, "C")).alias("chain"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """key:value lines (sta.txt)."""
    pairs = F.array(*[F.concat_ws(":", F.lit(c), F.col(c).cast("string")) for c in metrics.columns])
    metrics.select(F.array_join(pairs, "\n").alias("value")).coalesce(1).write.text(path)


def read_metrics(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(r["value"].split(":", 1) for r in spark.read.text(path).collect() if ":" in r["value"])  # a few lines


def save_markov(markov: DataFrame, path: str, nodes: int, arcs: int) -> None:
    markov.write.parquet(f"{path}/table")
    markov.sparkSession.createDataFrame([(nodes, arcs)], "nodes long, arcs long").write.json(f"{path}/meta")


def load_markov(spark: SparkSession, path: str, nodes: int, arcs: int) -> DataFrame:
    """The saved table; one trained on another graph is refused."""
    meta = spark.read.json(f"{path}/meta").first()
    if (meta["nodes"], meta["arcs"]) != (nodes, arcs):
        raise ValueError("the Markov table belongs to another graph")
    return spark.read.parquet(f"{path}/table")


def write_spectrum(table: DataFrame, path: str) -> None:
    kmers.spectrum(table).write.csv(path, sep="\t", header=True)


def write_worst_reads(compared: DataFrame, path: str) -> None:
    """Erroneous, perfect, corrected and alignment of reads with false positives, as four text tables."""
    bad = compared.filter("fp > 0").sort("rec_id")
    for name in ("erroneous", "perfect", "corrected", "header"):
        bad.select(F.concat_ws("\t", "rec_id", name).alias("value")).write.text(f"{path}/{name}")
