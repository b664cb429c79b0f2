"""Queries that save and load what other queries compute: nodes, Markov tables, contigs, worst reads, jobs on files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import chain_of
from ..operators import chains as C
from ..operators import evaluate
from ..session import work_dir
from ..sources import reads as R
from ..sources import sinks
from . import jobs
from . import sqltext as Q
from .chain_queries import DECIDED, MUT, SAMQ, decided, text, three_versions
from .graph_queries import K, G
from .registry import query
from .tables import benchmark_graph, event_chains, sequences

DOCS, BENCH = Q.seqs("documents", "doc_id"), Q.seqs("benchmark", "item_id")


def _path(spark, name: str) -> str:
    return f"{work_dir(spark)}/saved-{uuid.uuid4().hex}-{name}"


@query("s12_node_lines", f"WITH RECURSIVE {G} SELECT node_id, concat_ws(chr(9), 'NODE', node_id, length(seq) - {K - 1}, kmer_cov, 0) AS head, seq FROM un")
def node_lines(spark, sf):
    """The node file: a line of numbers and a line of bases for every node."""
    path = _path(spark, "nodes")
    sinks.node_text(benchmark_graph(spark, sf, K)[1]).write.option("lineSep", "\n\n").text(path)
    parts = F.split("value", "\n")
    return spark.read.option("lineSep", "\n\n").text(path).select(F.split(parts[0], "\t")[1].cast("int").alias("node_id"), parts[0].alias("head"), parts[1].alias("seq"))


@query("s13_rebuilt_arcs", f"WITH RECURSIVE {G} SELECT src, dst, base, cov FROM ar")
def rebuilt_arcs(spark, sf):
    """The saved graph's arcs, their targets found anew from the nodes' ends."""
    _, nodes, arcs = benchmark_graph(spark, sf, K)
    path = _path(spark, "graph")
    sinks.save_graph(nodes, arcs, path)
    return sinks.load_graph(spark, path, K)[1].select("src", "dst", "base", "cov")


@query("s20_saved_markov", f"WITH {DECIDED} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq, accepted FROM de")
def saved_markov(spark, sf):
    path = _path(spark, "markov")
    sinks.save_markov(decided(spark, sf), path, 5, 25)
    return sinks.load_markov(spark, path, 5, 25).select("ord", text("chain").alias("chain"), "next_node", "freq", "accepted")


@query("s21_contigs", f"WITH {DOCS} SELECT 'c' || doc_id AS rname, md5(seq) AS seq_md5, length(seq)::BIGINT AS len FROM s WHERE length(seq) > 0")
def contigs(spark, sf):
    """Names end at the first white space of the header."""
    path = _path(spark, "c.fasta")
    s = sequences(spark, sf).filter(F.length("seq") > 0)
    sinks.write_fasta(s.select(F.lit(0).alias("lib_id"), F.col("doc_id").alias("rec_id"), F.concat(F.lit(">c"), "doc_id", F.lit(" of a table\n")).alias("pre"), F.col("seq").alias("read")), path)
    return R.read_contigs(spark, path).select("rname", F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("len"))


@query("s25_worst_files", f"WITH {MUT}, t AS (SELECT item_id, string_agg(w, '' ORDER BY i) AS erroneous, string_agg(p, '' ORDER BY i) AS perfect, string_agg(c, '' ORDER BY i) AS corrected FROM m GROUP BY item_id) SELECT item_id, erroneous, perfect, corrected FROM t JOIN r USING (item_id) WHERE fp > 0")
def worst_files(spark, sf):
    """The files of reads that correction has made worse, read back."""
    wrong, perfect, fixed = three_versions(spark, sf)
    per = evaluate.per_read(evaluate.aligned_triples(evaluate.comparable(evaluate.three_reads(wrong, perfect, fixed))))
    named = lambda df, c: df.select("rec_id", F.col("read").alias(c))
    whole = per.join(named(wrong, "erroneous"), "rec_id").join(named(perfect, "perfect"), "rec_id").join(named(fixed, "corrected"), "rec_id").withColumn("header", F.concat(F.lit("@r"), "rec_id"))
    path = _path(spark, "worst")
    sinks.write_worst_reads(whole, path)
    out = None
    for c in ("erroneous", "perfect", "corrected"):
        f = F.split("value", "\t")
        part = spark.read.text(f"{path}/{c}").select(f[0].cast("long").alias("item_id"), f[1].alias(c))
        out = part if out is None else out.join(part, "item_id")
    return out


@query("p03_upper_case", f"WITH {DOCS} SELECT doc_id, md5(seq) AS seq_md5 FROM s WHERE length(seq) > 0")
def upper_case(spark, sf):
    """Reads written in small letters, as stage 1 reads them."""
    path = _path(spark, "l.fastq")
    s = sequences(spark, sf).filter(F.length("seq") > 0)
    small = F.lower("seq")
    sinks.write_reads(s.select(F.lit(0).alias("lib_id"), F.col("doc_id").alias("rec_id"), F.concat(F.lit("@r"), "doc_id", F.lit("\n")).alias("pre"), small.alias("read"), F.concat(F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")), F.lit("\n")).alias("post")), path)
    return jobs.input_sequences(spark, [path], ["pre"]).select(F.regexp_extract("pre", r"^@r(\d+)", 1).cast("long").alias("doc_id"), F.md5("seq").alias("seq_md5"))


@query("c01_sam_job", f"WITH {BENCH}, {SAMQ} SELECT row_number() OVER (ORDER BY item_id) - 1 AS rec_id, TRUE AS mapped, CASE WHEN turned THEN {Q.rc('out')} ELSE out END AS read FROM o")
def sam_job(spark, sf):
    """The command on files: reads, SAM rows and contigs are written, read (numbered in the order written) and projected."""
    s = sequences(spark, sf, "benchmark", "item_id").filter(F.length("seq") >= 60)
    name = F.concat(F.lit("q"), "item_id")
    cut = F.substring(F.col("seq"), F.lit(1), F.length("seq") - 13)
    reads, sam, genome = _path(spark, "r.fastq"), _path(spark, "a.sam"), _path(spark, "g.fasta")
    sinks.write_reads(s.select(F.lit(0).alias("lib_id"), F.col("item_id").alias("rec_id"), F.concat(F.lit("@"), name, F.lit("\n")).alias("pre"), cut.alias("read"), F.concat(F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(cut)), F.lit("\n")).alias("post")), reads)
    text_of = lambda c: c.cast("string")
    fields = [name, F.when(F.col("item_id") % 2 == 1, "16").otherwise("0"), name, text_of(F.col("item_id") % 7 + 1), F.lit("60"), F.concat(F.lit("5S20M2I3D"), F.length("seq") - 40, F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), cut, F.repeat(F.lit("I"), F.length(cut)), F.lit("NM:i:0")]
    s.select(F.concat_ws("\t", *fields).alias("value")).write.text(sam)
    sinks.write_fasta(s.select(F.lit(0).alias("lib_id"), F.col("item_id").alias("rec_id"), F.concat(F.lit(">"), name, F.lit("\n")).alias("pre"), F.col("seq").alias("read")), genome)
    return jobs.sam_to_alignment(spark, sam, genome, reads).select("rec_id", "mapped", "read")


LINKS = f"""{Q.STEPS}, ch AS (SELECT user_id, array_agg(node ORDER BY p) AS chain FROM st GROUP BY user_id),
li AS (SELECT user_id AS idx1, user_id + 1 AS idx2, len(chain)::BIGINT AS n FROM ch)"""


@query("g17_pair_report", f"WITH {LINKS} SELECT row_number() OVER (ORDER BY n DESC, idx1, idx2)::BIGINT AS place, idx1, idx2, n, {Q.join_text('a.chain')} AS chain1, {Q.join_text('b.chain')} AS chain2 FROM li JOIN ch a ON a.user_id = idx1 JOIN ch b ON b.user_id = idx2")
def pair_report(spark, sf):
    """Linked chains with their paths, the most linked first."""
    c = event_chains(spark, sf).withColumnRenamed("user_id", "chain_id")
    links = c.select(F.col("chain_id").alias("idx1"), (F.col("chain_id") + 1).alias("idx2"), F.size("chain").cast("long").alias("n"))
    report = C.numbered_report(links, c)
    return report.select("place", "idx1", "idx2", "n", text("chain1").alias("chain1"), text("chain2").alias("chain2"))


@query("s18_parsed_chains", f"WITH {Q.CHAINS} SELECT user_id, {Q.join_text('chain')} AS chain FROM ch")
def parsed_chains(spark, sf):
    """Chains as text and back."""
    c = event_chains(spark, sf)
    return c.select("user_id", text("chain").alias("t")).select("user_id", chain_of(F.col("t")).alias("chain")).select("user_id", text("chain").alias("chain"))
