"""Queries that write files and read them back: reads, SAM, graphs, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import kmers
from ..session import table, work_dir
from ..sources import reads as R
from ..sources import sinks
from . import sqltext as Q
from .graph_queries import K as GRAPH_K
from .registry import query
from .tables import K, benchmark_graph, sequences

BENCH = Q.seqs("benchmark", "item_id")
DOCS = Q.seqs("documents", "doc_id")
G = Q.graph(k=GRAPH_K)


def _new_path(spark, suffix: str) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}{suffix}"


def _library(spark, sf, name: str, key: str, mark: str):
    """A table's sequences as records; qualities are one letter, as long as the read."""
    read = F.col("seq")
    quality = F.repeat(F.lit("I"), F.length(read))
    return sequences(spark, sf, name, key).filter(F.length(read) > 0).select(
        F.lit(0).alias("lib_id"), F.col(key).alias("rec_id"), F.concat(F.lit(f"{mark}r"), key, F.lit(" x\n")).alias("pre"), read.alias("read"),
        F.concat(F.lit("\n+\n"), quality, F.lit("\n")).alias("post"), quality.alias("qual"),
    )


def _named(library, key: str):
    return library.select(F.regexp_extract("pre", r"^.r(\d+)", 1).cast("long").alias(key), F.md5("read").alias("read_md5"), F.length("read").cast("long").alias("len"))


@query("s01_fasta_scan", f"WITH {DOCS} SELECT doc_id, md5(seq) AS read_md5, length(seq)::BIGINT AS len FROM s WHERE length(seq) > 0")
def fasta_scan(spark, sf):
    path = _new_path(spark, ".fasta")
    sinks.write_fasta(_library(spark, sf, "documents", "doc_id", ">"), path)
    return _named(R.read_library(spark, path), "doc_id")


@query("s02_fastq_scan", f"WITH {DOCS} SELECT doc_id, md5(seq) AS read_md5, length(seq)::BIGINT AS len, length(seq)::BIGINT AS quals FROM s WHERE length(seq) > 0")
def fastq_scan(spark, sf):
    """Gzipped, four lines a record."""
    path = _new_path(spark, ".fastq")
    sinks.write_reads(_library(spark, sf, "documents", "doc_id", "@"), path, "gzip")
    library = R.read_library(spark, path)
    return library.select(F.regexp_extract("pre", r"^@r(\d+)", 1).cast("long").alias("doc_id"), F.md5("read").alias("read_md5"), F.length("read").cast("long").alias("len"), F.length("qual").cast("long").alias("quals"))


@query("s05_raw_scan", f"WITH {DOCS} SELECT md5(seq) AS read_md5, count(*) AS copies FROM s WHERE length(seq) > 0 GROUP BY 1")
def raw_scan(spark, sf):
    path = _new_path(spark, ".raw")
    sinks.write_reads(_library(spark, sf, "documents", "doc_id", "").select("lib_id", "rec_id", F.lit("").alias("pre"), "read", F.lit("\n").alias("post")), path)
    return R.read_library(spark, path).groupBy(F.md5("read").alias("read_md5")).agg(F.count(F.lit(1)).alias("copies"))


SAM_FLAG = "(doc_id * 37 % 4096)"


@query("s21_sam_scan", f"WITH {DOCS} SELECT doc_id, {SAM_FLAG}::INTEGER AS flag, (doc_id % 1000 + 1)::INTEGER AS pos, length(seq) || 'M' AS cigar, md5(seq) AS seq_md5, (doc_id % 9)::INTEGER AS nm, CASE WHEN doc_id % 2 = 0 THEN 'c2,-7,5M,1;' ELSE '' END AS xa, {SAM_FLAG} & 16 <> 0 AS reverse FROM s WHERE length(seq) > 0")
def sam_scan(spark, sf):
    """Alignment rows with NM and, in every other row, XA; header lines are skipped."""
    path = _new_path(spark, ".sam")
    i = F.col("rec_id")
    text = lambda c: c.cast("string")
    fields = [F.concat(F.lit("r"), i), text(i * 37 % 4096), F.lit("c1"), text(i % 1000 + 1), F.lit("60"), F.concat(F.length("read"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.col("read"), F.col("qual"), F.concat(F.lit("NM:i:"), i % 9), F.when(i % 2 == 0, "XA:Z:c2,-7,5M,1;").otherwise("XT:A:U")]
    rows = _library(spark, sf, "documents", "doc_id", "@").select(F.concat(F.lit("@CO\tof the next row\n"), F.concat_ws("\t", *fields)).alias("value"))
    rows.write.text(path)
    sam = R.with_flags(R.read_sam(spark, path))
    return sam.select(F.substring("qname", 2, 30).cast("long").alias("doc_id"), "flag", "pos", "cigar", F.md5("seq").alias("seq_md5"), "nm", "xa", F.col("is_reverse").alias("reverse"))


@query("s04_sam_reads", f"WITH {DOCS} SELECT doc_id, md5(seq) AS read_md5, length(seq)::BIGINT AS len FROM s WHERE length(seq) > 0")
def sam_reads(spark, sf):
    path = _new_path(spark, ".sam")
    line = F.concat_ws("\t", F.concat(F.lit("r"), "rec_id"), *[F.lit(x) for x in ("0", "c1", "1", "60", "*", "*", "0", "0")], F.col("read"), F.col("qual"))
    _library(spark, sf, "documents", "doc_id", "@").select(line.alias("value")).write.text(path)
    library = R.read_library(spark, path)
    return library.select(F.regexp_extract("pre", r"^r(\d+)", 1).cast("long").alias("doc_id"), F.md5("read").alias("read_md5"), F.length("read").cast("long").alias("len"))


@query("s10_library_stats", f"""WITH {DOCS}, {Q.seqs('benchmark', 'item_id', 'b')}, x AS (SELECT 0 AS lib_id, seq FROM s WHERE length(seq) > 0 UNION ALL SELECT 1, seq FROM b WHERE length(seq) > 0)
SELECT lib_id::BIGINT AS lib_id, count(*) AS num_reads, round(avg(length(seq)), 6) AS avg_read_len, max(length(seq))::BIGINT AS max_read_len FROM x GROUP BY lib_id""")
def stored_library_stats(spark, sf):
    """Two libraries of unlike types read as one, their statistics written and read back."""
    fasta, fastq, out = _new_path(spark, ".fasta"), _new_path(spark, ".fastq"), _new_path(spark, ".met")
    sinks.write_fasta(_library(spark, sf, "documents", "doc_id", ">"), fasta)
    sinks.write_reads(_library(spark, sf, "benchmark", "item_id", "@"), fastq)
    sinks.write_stats(R.library_stats(R.read_libraries(spark, [fasta, fastq])), out)
    s = sinks.read_stats(spark, out)
    return s.select(F.col("lib_id").cast("long").alias("lib_id"), "num_reads", F.round("avg_read_len", 6).alias("avg_read_len"), F.col("max_read_len").cast("long").alias("max_read_len"))


@query("s11_kmer_store", f"WITH {BENCH}, {Q.kmers('item_id')} SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1")
def kmer_store(spark, sf):
    path = _new_path(spark, "")
    sinks.write_kmers(kmers.kmer_counts(sequences(spark, sf, "benchmark", "item_id"), K), path)
    return sinks.read_kmers(spark, path).select("canon", "n")


@query("s12_arc_lines", f"WITH RECURSIVE {G} SELECT abs(src) || chr(9) || count(*) || chr(9) || string_agg(cov::VARCHAR, chr(9) ORDER BY src, base, cov) AS line FROM ar GROUP BY abs(src)")
def arc_lines(spark, sf):
    return sinks.arc_text(benchmark_graph(spark, sf, GRAPH_K)[2]).select(F.col("value").alias("line"))


@query("s17_cytoscape", f"WITH RECURSIVE {G} SELECT src, dst, cov, (SELECT md5(seq) FROM un WHERE node_id = abs(src)) AS src_md5 FROM ar")
def cytoscape(spark, sf):
    """Arc and node tables written and read again, arcs with their source node's sequence."""
    path = _new_path(spark, "")
    _, nodes, arcs = benchmark_graph(spark, sf, GRAPH_K)
    sinks.write_cytoscape(nodes, arcs, path)
    a = spark.read.csv(f"{path}.arcs", sep="\t", header=True, schema=arcs.select("src", "dst", "cov").schema)
    n = spark.read.csv(f"{path}.nodes", sep="\t", header=True, schema=nodes.select("node_id", "marg_len", "kmer_cov", "seq").schema)
    return a.join(n, F.abs("src") == F.col("node_id")).select("src", "dst", "cov", F.md5("seq").alias("src_md5"))


@query("s23_spectrum_file", f"WITH {BENCH}, {Q.kmers('item_id')}, kc AS (SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1) SELECT least(n, 65535)::BIGINT AS multiplicity, count(*) AS kmers FROM kc GROUP BY 1")
def spectrum_file(spark, sf):
    path = _new_path(spark, "")
    sinks.write_spectrum(kmers.kmer_counts(sequences(spark, sf, "benchmark", "item_id"), K), path)
    return spark.read.csv(path, sep="\t", header=True, schema="multiplicity long, kmers long")


@query("s19_metrics_file", "SELECT count(*)::VARCHAR AS orders, sum(o_orderkey)::VARCHAR AS keys FROM orders")
def metrics_file(spark, sf):
    path = _new_path(spark, "")
    sinks.write_metrics(table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys")), path)
    found = sinks.read_metrics(spark, path)
    return spark.createDataFrame([(found["orders"], found["keys"])], "orders string, keys string")
