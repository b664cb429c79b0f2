"""Alignment held against SQL: reads that lie in the graph as they are, and reads that only matches below k lead to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extend, graph, markov, reduce
from ..session import materialise
from . import sqltext as Q
from .graph_queries import mutated_reads
from .registry import query
from .tables import benchmark_graph, sequences

#: The benchmark's sequences branch at 11 and hardly at 21, where the fall-back to shorter matches works.
K, FALLBACK_K = 11, 21
READ, STEP = 120, 60
#: Every so many bases one is turned, so that no 21-mer of a read is in the graph; the ends keep a distance.
TURN_EVERY, TURN_AT, TURNED_READ = 19, 10, 96
BENCH = Q.seqs("benchmark", "item_id")


def exact_reads(spark, sf, read: int = READ):
    """``rec_id, seq``: pieces of the benchmark's sequences, those of bases only."""
    s = sequences(spark, sf, "benchmark", "item_id")
    cut = s.select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - STEP, F.lit(0)), F.lit(STEP))).alias("at"))
    reads = cut.select((F.col("item_id") * 1000 + F.col("at") / STEP).cast("long").alias("rec_id"), F.substring("seq", F.col("at") + 1, read).alias("seq"))
    return reads.filter(~F.col("seq").contains("N") & (F.length("seq") >= FALLBACK_K))


READS = f"""re AS (SELECT item_id * 1000 + a0 // {STEP} AS rec_id, substr(seq, a0 + 1, {READ}) AS r FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - {STEP}, 0) + 1, {STEP})) AS a0 FROM s) x
  WHERE NOT contains(substr(seq, a0 + 1, {READ}), 'N') AND length(substr(seq, a0 + 1, {READ})) >= {FALLBACK_K})"""
# where each k-mer of a read lies in the graph; a new step of its chain begins where the next k-mer isn't the next of the node
CHAINS = f"""{Q.graph(k=K)}, {READS},
nk AS (SELECT node, i AS pos, substr(seq, i + 1, {K}) AS kmer FROM (SELECT node, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM sn) x),
rk AS (SELECT rec_id, r, i AS rpos, substr(r, i + 1, {K}) AS kmer FROM (SELECT rec_id, r, unnest(range(0, length(r) - {K - 1})) AS i FROM re) x),
pl AS (SELECT rec_id, r, rpos, node, pos, lag(node) OVER w AS p_node, lag(pos) OVER w AS p_pos FROM rk JOIN nk USING (kmer) WINDOW w AS (PARTITION BY rec_id ORDER BY rpos)),
cn AS (SELECT rec_id, any_value(r) AS r, array_agg(node ORDER BY rpos) FILTER (WHERE p_node IS NULL OR node <> p_node OR pos <> p_pos + 1) AS chain, arg_min(pos, rpos) AS pos_first, arg_max(pos, rpos) + {K} AS pos_last FROM pl GROUP BY rec_id)"""


def exact_alignments(spark, sf):
    _, nodes, arcs = benchmark_graph(spark, sf, K)
    reads = materialise(exact_reads(spark, sf), "reads")
    return materialise(extend.align_pass1(reads, nodes, arcs, K), "aligned"), arcs


@query("l16_exact_reads", f"WITH RECURSIVE {CHAINS} SELECT rec_id, true AS aligned, length(r)::INTEGER AS score, {Q.join_text('chain')} AS chain, pos_first::INTEGER AS pos_first, pos_last::INTEGER AS pos_last, r AS corrected FROM cn")
def exact_read_alignments(spark, sf):
    """Reads that the graph spells: full score, the chain of their own k-mers, nothing corrected."""
    found, _ = exact_alignments(spark, sf)
    return found.select("rec_id", "aligned", "score", F.array_join(F.col("chain").cast("array<string>"), " ").alias("chain"), "pos_first", "pos_last", "corrected")


@query("a05_exact_metrics", f"WITH {BENCH}, {READS} SELECT count(*) AS num_reads, avg(length(r)) AS avg_read_len, max(length(r))::INTEGER AS max_read_len, 0::BIGINT AS num_substitutions, count(*) AS num_corr_reads FROM re")
def exact_metrics(spark, sf):
    return extend.alignment_metrics(exact_alignments(spark, sf)[0], K)


@query("g13_exact_arc_coverage", f"WITH RECURSIVE {CHAINS}, st AS (SELECT unnest(list_zip(chain[:-2], chain[2:])) AS x FROM cn WHERE len(chain) > 1), pr AS (SELECT x[1] AS src, x[2] AS dst FROM st UNION ALL SELECT -x[2], -x[1] FROM st), wa AS (SELECT src, dst, count(*) AS walked FROM pr GROUP BY src, dst) SELECT ar.src, ar.dst, ar.cov, coalesce(walked, 0) AS walked FROM ar LEFT JOIN wa ON wa.src = ar.src AND wa.dst = ar.dst")
def exact_arc_coverage(spark, sf):
    found, arcs = exact_alignments(spark, sf)
    return graph.arc_coverage(arcs, found.filter("aligned").select("chain")).select("src", "dst", "cov", "walked")


TURNED = f"""pe AS (SELECT item_id * 1000 + a0 // {STEP} AS rec_id, substr(seq, a0 + 1, {TURNED_READ}) AS r FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - {STEP}, 0) + 1, {STEP})) AS a0 FROM s) x)"""
ERRORS = len(range(TURN_AT, TURNED_READ, TURN_EVERY))


def turned_reads(spark, sf):
    perfect = exact_reads(spark, sf, TURNED_READ).filter(F.length("seq") == TURNED_READ)
    base = lambda i: F.col("seq").substr(i, F.lit(1))
    turned = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when((i - 1) % TURN_EVERY == TURN_AT, F.translate(base(i), "ACGT", "CGTA")).otherwise(base(i)))
    return materialise(perfect.select("rec_id", F.array_join(turned, "").alias("seq")), "reads")


@query("l15_match_fallback", f"WITH {BENCH}, {TURNED} SELECT rec_id, true AS aligned, {TURNED_READ - 2 * ERRORS}::INTEGER AS score, r AS corrected FROM pe WHERE length(r) = {TURNED_READ} AND NOT contains(r, 'N')")
def match_fallback(spark, sf):
    """Reads without a 21-mer of the graph: exact matches of 16 bases or more lead to it, and every turned base is restored."""
    _, nodes, arcs = benchmark_graph(spark, sf, FALLBACK_K)
    reads = turned_reads(spark, sf)
    return extend.align_pass1(reads, nodes, arcs, FALLBACK_K).select("rec_id", "aligned", "score", "corrected")


@query("l15_without_fallback", f"WITH {BENCH}, {TURNED} SELECT count(*) AS reads, 0::BIGINT AS aligned FROM pe WHERE length(r) = {TURNED_READ} AND NOT contains(r, 'N')")
def without_fallback(spark, sf):
    """The same reads by k-mer seeds alone: none is aligned."""
    _, nodes, arcs = benchmark_graph(spark, sf, FALLBACK_K)
    reads = turned_reads(spark, sf)
    found = extend.align_pass1(reads, nodes, arcs, FALLBACK_K, mem=False)
    return found.agg(F.count(F.lit(1)).alias("reads"), F.count_if("aligned").alias("aligned"))


ORDERS = (2, 3, 4)
# reads with turned bases; where each of their k-mers lies; runs that lie where they would without the errors between them
SEEDS = f"""{Q.graph(k=K)}, cu AS (SELECT item_id * 1000 + a0 // 60 AS rec_id, substr(seq, a0 + 1, 120) AS p FROM (SELECT item_id, seq, unnest(range(0, greatest(length(seq) - 60, 0) + 1, 60)) AS a0 FROM s) x),
re AS (SELECT rec_id, array_to_string(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN i % 37 = 0 THEN translate(substr(p, i::INTEGER, 1), 'ACGT', 'CGTA') ELSE substr(p, i::INTEGER, 1) END), '') AS r FROM cu),
nk AS (SELECT node, i AS pos, substr(seq, i + 1, {K}) AS kmer, length(seq) - {K - 1} AS m FROM (SELECT node, seq, unnest(range(0, length(seq) - {K - 1})) AS i FROM sn) x),
rk AS (SELECT rec_id, i AS rpos, substr(r, i + 1, {K}) AS kmer FROM (SELECT rec_id, r, unnest(range(0, length(r) - {K - 1})) AS i FROM re WHERE length(r) >= {K + 2}) x),
pl AS (SELECT rec_id, rpos, node, pos, m, lag(node) OVER w AS p_node, lag(pos) OVER w AS p_pos, lag(m) OVER w AS p_m, lag(rpos) OVER w AS p_rpos FROM rk JOIN nk USING (kmer) WINDOW w AS (PARTITION BY rec_id ORDER BY rpos)),
ad AS (SELECT DISTINCT src, dst FROM ar),
is0 AS (SELECT pl.*, coalesce((node = p_node AND pos > p_pos AND pos - p_pos = rpos - p_rpos) OR (ad.src IS NOT NULL AND p_m - p_pos + pos = rpos - p_rpos), FALSE) AS goes_on FROM pl LEFT JOIN ad ON ad.src = p_node AND ad.dst = node),
is1 AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY rpos) AS island FROM is0),
ch AS (SELECT rec_id, island, array_agg(node ORDER BY rpos) FILTER (WHERE NOT goes_on OR node <> p_node) AS chain FROM is1 GROUP BY 1, 2)"""
TRAINED = f"""{SEEDS}, {Q.grams(ORDERS)}, br AS (SELECT src FROM ar GROUP BY 1 HAVING count(*) > 1),
tr AS (SELECT ord, chain, next_node, count(*) AS freq FROM gr WHERE chain[-1] IN (SELECT src FROM br) GROUP BY ALL),
st AS (SELECT floor(count(*)::DOUBLE / (SELECT sum(length(seq) - {K - 1}) FROM un) * avg(length(r))) AS cover, greatest(floor(avg(length(r))), 1) AS mean FROM re),
le AS (SELECT ord, chain, next_node, freq, ({K + 1} + (SELECT sum(length(seq) - {K - 1}) FROM (SELECT unnest(chain[2:]) AS n) q JOIN un ON un.node_id = abs(n)))::DOUBLE AS avg_len FROM tr),
ex AS (SELECT le.*, greatest(0, cover / mean * (mean - avg_len + 1) * pow(1 - 0.005::DOUBLE, avg_len)) AS expected FROM le, st),
od AS (SELECT *, CASE WHEN expected > 0 THEN (freq * (ln(1.0::DOUBLE) - ln(expected)) - 1 + expected) / ln(10.0::DOUBLE) END AS odds FROM ex),
de AS (SELECT *, NOT coalesce(expected >= 10 AND odds > 5 AND freq < expected, FALSE) AS accepted FROM od),
s2 AS (SELECT chain FROM de WHERE ord = 2 AND accepted GROUP BY chain HAVING count(*) = 1),
p2 AS (SELECT * FROM de WHERE ord = 2 OR chain[-2:] NOT IN (SELECT chain FROM s2)),
s3 AS (SELECT chain FROM p2 WHERE ord = 3 AND accepted GROUP BY chain HAVING count(*) = 1),
p3 AS (SELECT * FROM p2 WHERE ord <= 3 OR chain[-3:] NOT IN (SELECT chain FROM s3))"""


@query("m02_seed_chains", f"WITH RECURSIVE {SEEDS} SELECT rec_id, {Q.join_text('chain')} AS chain FROM ch WHERE len(chain) >= 3")
def seed_chains(spark, sf):
    """Node paths of reads with turned bases, from their k-mers alone."""
    _, nodes, arcs = benchmark_graph(spark, sf, K)
    found = markov.seed_chains(mutated_reads(spark, sf), nodes, arcs, K)
    return found.select("rec_id", F.array_join(F.col("chain").cast("array<string>"), " ").alias("chain"))


@query("m02_seed_table", f"WITH RECURSIVE {TRAINED} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq, avg_len, round(expected, 9) AS expected, accepted FROM p3")
def seed_table(spark, sf):
    """The Markov table trained from k-mers: reads to table without an alignment."""
    _, nodes, arcs = benchmark_graph(spark, sf, K)
    t = markov.train_from_seeds(mutated_reads(spark, sf), nodes, arcs, K, ORDERS)
    return t.select("ord", F.array_join(F.col("chain").cast("array<string>"), " ").alias("chain"), "next_node", "freq", "avg_len", F.round("expected", 9).alias("expected"), "accepted")


# paths of reads on both strands from every place on; where all of them agree, and so do those that come back from the end
REDUCED = f"""{CHAINS}, bo AS (SELECT chain AS s FROM cn UNION ALL SELECT {Q.back('chain')} FROM cn),
se AS (SELECT s[i] AS a, s[i + 1] AS b, s[i:] AS s FROM (SELECT s, unnest(range(1, len(s))) AS i FROM bo) x),
si AS (SELECT src AS a, min(dst) AS b FROM ar GROUP BY 1 HAVING count(DISTINCT dst) = 1 AND abs(src) <> abs(min(dst))),
lv AS (SELECT a, l, count(DISTINCT s[l]) AS c, min(s[l]) AS y, min(s[:l]) AS path FROM (SELECT a, s, unnest(range(3, len(s) + 1)) AS l FROM se JOIN si USING (a, b)) x GROUP BY 1, 2),
sp AS (SELECT a, min(l) AS stop FROM lv WHERE c > 1 OR abs(y) = abs(a) GROUP BY 1),
ca AS (SELECT lv.a, l, path FROM lv LEFT JOIN sp USING (a) WHERE (stop IS NULL OR l < stop) AND NOT list_contains(list_transform(path[:l - 1], lambda v: abs(v)), abs(path[l]))),
ju AS (SELECT ca.a, l, path FROM ca JOIN se ON se.a = -path[-1] AND se.b = -path[-2] GROUP BY 1, 2, 3 HAVING bool_and(s[1:l] = ({Q.back('path')})[1:least(len(s), l)]) AND max(len(s)) >= l),
rd AS (SELECT a, arg_min(path, l) AS path FROM ju GROUP BY 1),
re1 AS (SELECT a, path FROM rd WHERE path[-1] IN (SELECT dst FROM ar GROUP BY 1 HAVING count(DISTINCT src) > 1) OR path < {Q.back('path')}),
us AS (SELECT path, abs(path[1]) AS node, TRUE AS e FROM re1 UNION SELECT path, abs(path[-1]), TRUE FROM re1 UNION SELECT path, abs(unnest(path[2:-2])), FALSE FROM re1),
le AS (SELECT node, min(path) FILTER (WHERE e) AS le, min(path) FILTER (WHERE NOT e) AS li FROM us GROUP BY 1),
ch1 AS (SELECT a, path FROM re1 WHERE path NOT IN (SELECT path FROM us JOIN le USING (node) WHERE coalesce(le.le < path, FALSE) OR (e AND coalesce(le.li < path, FALSE))))"""


def read_paths(spark, sf):
    """Graph and node paths of the benchmark's reads, from their k-mers."""
    _, nodes, arcs = benchmark_graph(spark, sf, K)
    chains = markov.seed_chains(exact_reads(spark, sf), nodes, arcs, K, least=1).withColumnRenamed("rec_id", "chain_id")
    return nodes, arcs, materialise(chains, "chains")


def _text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query("g12_chain_reductions", f"WITH RECURSIVE {REDUCED} SELECT a, {Q.join_text('path')} AS path FROM re1")
def chain_reductions(spark, sf):
    """Paths that reads take without a choice from a node with one way on."""
    _, arcs, chains = read_paths(spark, sf)
    return reduce.find_reductions(arcs, chains).select("a", _text("path").alias("path"))


@query("g15_reduction_round", f"""WITH RECURSIVE {REDUCED}, en AS (SELECT path[1] AS a, path[2] AS b, path[-2] AS x, path[-1] AS y FROM ch1),
go AS (SELECT a AS src, b AS dst FROM en UNION SELECT x, y FROM en UNION SELECT -b, -a FROM en UNION SELECT -y, -x FROM en)
SELECT src, dst FROM ad0 WHERE (src, dst) NOT IN (SELECT (src, dst) FROM go) UNION ALL SELECT a, y FROM en UNION ALL SELECT -y, -a FROM en""".replace("FROM ad0", "FROM (SELECT DISTINCT src, dst FROM ar) ad0"))
def reduction_round(spark, sf):
    """Arcs after one round of reductions that don't meet."""
    nodes, arcs, chains = read_paths(spark, sf)
    done = reduce.reduce_round(nodes, arcs, chains, K)
    return (arcs if done is None else done[1]).select("src", "dst").distinct()
