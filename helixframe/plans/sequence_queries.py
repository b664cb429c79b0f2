"""Queries on sequences, k-mers, functions and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import stats
from ..functions.align import free_score, lcs_score, nw_banded, nw_score
from ..functions.text import FLAG_BITS, alignment_info, chain_of, cigar_tokens, flag, same_read, tag
from ..operators import graph, kmers, seeds
from ..session import materialise, table
from ..sources import sinks
from . import sqltext as Q
from .registry import query
from .tables import K, sequences

BENCH = Q.seqs("benchmark", "item_id")
DOCS = Q.seqs("documents", "doc_id")


@query("f01_seq_encode", f"WITH {DOCS} SELECT doc_id, md5(seq) AS seq_md5, length(seq)::BIGINT AS len, length(replace(seq, 'N', ''))::BIGINT AS acgt FROM s")
def seq_encode(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("seq")
    return sequences(spark, sf).select("doc_id", F.md5(s).alias("seq_md5"), F.length(s).cast("long").alias("len"), F.length(F.replace(s, F.lit("N"), F.lit(""))).cast("long").alias("acgt"))


@query("f01_pack_kmers", f"WITH {BENCH}, {Q.kmers('item_id')} SELECT item_id, pos, list_sum(list_transform(range(1, {K + 1}), lambda i: (instr('ACGT', substr(kmer, i::INTEGER, 1)) - 1) * (1::BIGINT << (2 * (i - 1))::INTEGER)))::BIGINT AS packed, kmer AS unpacked FROM km")
def pack_kmers(spark, sf):
    rows = kmers.kmer_rows(sequences(spark, sf, "benchmark", "item_id"), K, ["item_id"])
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), S.pack(F.col("kmer")).alias("packed")).withColumn("unpacked", S.unpack(F.col("packed"), K))


def _code_sql(first: int, last: int) -> str:
    """Bases ``first`` to ``last`` (from 1) of a k-mer as a whole number."""
    return f"list_sum(list_transform(range({first}, {last + 1}), lambda i: (instr('ACGT', substr(kmer, i::INTEGER, 1)) - 1)::HUGEINT * (1::HUGEINT << (2 * (i - {first}))::INTEGER)))"


@query("f05_long_codes", f"WITH {BENCH}, {Q.kmers('item_id', 63)}, d AS (SELECT DISTINCT kmer FROM km) SELECT kmer, {_code_sql(33, 63)}::BIGINT AS high, ({_code_sql(1, 32)} - 9223372036854775808::HUGEINT)::BIGINT AS low, row_number() OVER (ORDER BY reverse(kmer))::BIGINT AS colex_rank FROM d")
def long_codes(spark, sf):
    """Distinct 63-mers as codes of two longs, numbered in the codes' order."""
    from ..session import numbered

    d = kmers.kmer_rows(sequences(spark, sf, "benchmark", "item_id"), 63).select(S.pack_long(F.col("kmer")).alias("code")).distinct()
    return numbered(d, ["code"], "colex_rank").select(S.unpack_long(F.col("code"), 63).alias("kmer"), "code.high", "code.low", "colex_rank")


@query("f02_revcomp", f"WITH {BENCH} SELECT item_id, {Q.rc('seq')} AS rc FROM s")
def revcomp(spark, sf):
    return sequences(spark, sf, "benchmark", "item_id").select("item_id", S.revcomp(F.col("seq")).alias("rc"))


@query("f03_canonical", f"WITH {BENCH}, {Q.kmers('item_id')} SELECT item_id, pos, {Q.canon('kmer')} AS canon, {Q.turned('kmer')} AS turned FROM km")
def canonical(spark, sf):
    k = F.col("kmer")
    return kmers.kmer_rows(sequences(spark, sf, "benchmark", "item_id"), K, ["item_id"]).select("item_id", F.col("pos").cast("long").alias("pos"), S.canonical(k).alias("canon"), S.is_reversed(k).alias("turned"))


@query("f04_push_peek", f"WITH {BENCH}, {Q.kmers('item_id')} SELECT item_id, pos, substr(kmer, 2) || 'A' AS pushed_right, 'C' || substr(kmer, 1, {K - 1}) AS pushed_left, substr(kmer, 1, 1) AS peek_l, right(kmer, 1) AS peek_r FROM km")
def push_peek(spark, sf):
    k = F.col("kmer")
    return kmers.kmer_rows(sequences(spark, sf, "benchmark", "item_id"), K, ["item_id"]).select("item_id", F.col("pos").cast("long").alias("pos"), S.push_right(k, F.lit("A")).alias("pushed_right"), S.push_left(k, F.lit("C"), K).alias("pushed_left"), S.peek_left(k).alias("peek_l"), S.peek_right(k).alias("peek_r"))


@query("f05_kmer_order", f"WITH {BENCH}, {Q.kmers('item_id')}, d AS (SELECT DISTINCT kmer FROM km) SELECT kmer, row_number() OVER (ORDER BY reverse(kmer))::BIGINT AS colex_rank FROM d")
def kmer_order(spark, sf):
    from ..session import numbered

    d = kmers.kmer_rows(sequences(spark, sf, "benchmark", "item_id"), K).select("kmer", F.reverse("kmer").alias("key")).distinct()
    return numbered(d, ["key"], "colex_rank").select("kmer", "colex_rank")


@query("f06_kmer_iterators", f"WITH {BENCH}, {Q.kmers('item_id')} SELECT item_id, pos, kmer AS forward, (length(seq) - {K} - pos)::BIGINT AS reverse_pos, {Q.rc('kmer')} AS backward FROM km")
def kmer_iterators(spark, sf):
    s = sequences(spark, sf, "benchmark", "item_id").withColumn("n", F.length("seq"))
    rows = kmers.kmer_rows(s, K, ["item_id", "n"])
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("kmer").alias("forward"), (F.col("n") - K - F.col("pos")).cast("long").alias("reverse_pos"), S.revcomp(F.col("kmer")).alias("backward"))


@query("f07_marginal_peek", f"WITH {BENCH} SELECT item_id, substr(seq, {K}, 1) AS first_base, CASE WHEN length(seq) >= {K} THEN substr(reverse(seq), {K}, 1) END AS last_base, (length(seq) - {K - 1})::BIGINT AS marg_len FROM s")
def marginal_peek(spark, sf):
    s = F.col("seq")
    return sequences(spark, sf, "benchmark", "item_id").select("item_id", S.marginal_first(s, K).alias("first_base"), S.marginal_last(s, K).alias("last_base"), S.marginal_length(s, K).cast("long").alias("marg_len"))


@query("f08_mask_operations", f"WITH {BENCH}, {Q.overlaps('item_id')} SELECT bf::BIGINT AS m, count(*) AS kmers, {Q.reversed_byte('bf::INTEGER')}::BIGINT AS rc, bit_count((bf & 240)::INTEGER)::BIGINT AS left_degree, bit_count((bf & 15)::INTEGER)::BIGINT AS right_degree, (bf & 15) = 0 OR (bf & 240) = 0 AS dead_end, (bf | 128)::BIGINT AS marked, (bf & (255 - 4))::BIGINT AS unmarked, (bf & 2) <> 0 AS right_g FROM ov GROUP BY bf")
def mask_operations(spark, sf):
    """The operations on every neighbour mask of the benchmark's k-mers."""
    m = F.col("m")
    masks = kmers.overlap_table(sequences(spark, sf, "benchmark", "item_id"), K).groupBy(F.col("bf").cast("int").alias("m")).agg(F.count(F.lit(1)).alias("kmers"))
    return masks.select(
        m.cast("long").alias("m"), "kmers", S.revcomp_mask(m).cast("long").alias("rc"), S.left_degree(m).cast("long").alias("left_degree"), S.right_degree(m).cast("long").alias("right_degree"), S.is_dead_end(m).alias("dead_end"),
        S.mark(m, S.left_bit(F.lit("A"))).cast("long").alias("marked"), S.unmark(m, S.right_bit(F.lit("C"))).cast("long").alias("unmarked"), S.has(m, S.right_bit(F.lit("G"))).alias("right_g"),
    )


@query("f09_poisson_table", "SELECT n, mu, items, round(exp(n * ln(mu) - mu - lf), 12) AS pdf, round(n * ln(mu) - mu - lf, 9) AS log_pdf FROM (SELECT n, mu, items, coalesce((SELECT sum(ln(i)) FROM range(2, n + 1) r(i)), 0) AS lf FROM (SELECT l_quantity::BIGINT AS n, l_linenumber * 7.5::DOUBLE AS mu, count(*) AS items FROM lineitem GROUP BY 1, 2) a) x")
def poisson_table(spark, sf):
    """Poisson values of every quantity with a mean by line number."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("n"), (F.col("l_linenumber") * F.lit(7.5)).alias("mu")).agg(F.count(F.lit(1)).alias("items"))
    lp = stats.log_poisson(F.col("n"), F.col("mu"))
    return t.select("n", "mu", "items", F.round(F.exp(lp), 12).alias("pdf"), F.round(lp, 9).alias("log_pdf"))


@query("f10_negative_binomial", "SELECT k, items, round(exp(lgamma(10.0 + k) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1.0) END - lgamma(10.0) + 10 * ln(0.5) + k * ln(0.5)), 9) AS pdf FROM (SELECT l_quantity::BIGINT AS k, count(*) AS items FROM lineitem GROUP BY 1) x")
def negative_binomial(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("items"))
    return t.select("k", "items", F.round(stats.negative_binomial(F.col("k").cast("double"), F.lit(10.0), F.lit(20.0)), 9).alias("pdf"))


@query("f12_split_fields", "SELECT event_id, string_split(props, ':')[1] AS head, len(string_split(props, ':'))::BIGINT AS fields FROM events")
def split_fields(spark, sf):
    from ..functions.text import split_chars

    f = split_chars(F.col("props"), ":")
    return table(spark, sf, "events").select("event_id", f[0].alias("head"), F.size(f).cast("long").alias("fields"))


SAM_SQL = """sam AS (SELECT l_orderkey, l_linenumber, ((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 4096)::INTEGER AS flag,
  (l_linenumber::INTEGER) || 'S' || (l_quantity::INTEGER) || 'M' || (l_suppkey % 5 + 1) || CASE WHEN l_partkey % 2 = 0 THEN 'I' ELSE 'D' END || (l_partkey % 30 + 1) || 'M' AS cigar,
  (l_partkey % 4)::INTEGER AS nm FROM lineitem)"""


def sam_rows(spark, sf):
    l = table(spark, sf, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    cigar = F.concat(line.cast("int"), F.lit("S"), F.col("l_quantity").cast("int"), F.lit("M"), supp % 5 + 1, F.when(part % 2 == 0, "I").otherwise("D"), part % 30 + 1, F.lit("M"))
    return l.select("l_orderkey", "l_linenumber", ((part * 31 + supp * 7 + line) % 4096).cast("int").alias("flag"), cigar.alias("cigar"), (part % 4).cast("int").alias("nm"))


@query("f13_cigar_tokens", f"""WITH {SAM_SQL}, t AS (SELECT l_orderkey, l_linenumber, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHPX=])')) AS t FROM sam)
SELECT l_orderkey, l_linenumber, right(t, 1) AS op, sum(left(t, length(t) - 1)::INTEGER)::BIGINT AS bases, count(*) AS ops FROM t GROUP BY ALL""")
def cigar_token_query(spark, sf):
    t = sam_rows(spark, sf).select("l_orderkey", "l_linenumber", F.explode(cigar_tokens(F.col("cigar"))).alias("t"))
    return t.groupBy("l_orderkey", "l_linenumber", F.col("t.op").alias("op")).agg(F.sum("t.n").alias("bases"), F.count(F.lit(1)).alias("ops"))


@query("f14_sam_flags", f"WITH {SAM_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE (flag & {b}) <> 0) AS {n}" for n, b in FLAG_BITS.items()) + " FROM sam")
def sam_flags(spark, sf):
    return sam_rows(spark, sf).agg(*[F.count_if(flag(F.col("flag"), n)).alias(n) for n in FLAG_BITS])


@query("p12_primary_rows", f"WITH {SAM_SQL} SELECT count(*) FILTER (WHERE (flag & 2304) = 0) AS primary_rows, count(*) FILTER (WHERE (flag & 2304) = 0 AND regexp_full_match(cigar, '(\\d+[MSI])+')) AS supported FROM sam")
def primary_rows(spark, sf):
    from ..functions.text import cigar_supported
    from ..sources.reads import primary

    return primary(sam_rows(spark, sf)).agg(F.count(F.lit(1)).alias("primary_rows"), F.count_if(cigar_supported(F.col("cigar"), "MSI")).alias("supported"))


@query("c03_match_score", f"""WITH {SAM_SQL}, t AS (SELECT l_orderkey, l_linenumber, nm, unnest(regexp_extract_all(cigar, '\\d+M')) AS t FROM sam)
SELECT t.l_orderkey, (sum(left(t, length(t) - 1)::INTEGER) - (SELECT sum(nm) FROM sam x WHERE x.l_orderkey = t.l_orderkey))::BIGINT AS score FROM t GROUP BY t.l_orderkey""")
def match_scores(spark, sf):
    from ..operators.evaluate import match_score

    return sam_rows(spark, sf).groupBy("l_orderkey").agg(F.sum(match_score(F.col("cigar"), F.col("nm"))).cast("long").alias("score"))


@query("s22_xa_best", """WITH x AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, (l_partkey % 97 + 5) AS n, (l_suppkey % 6) AS nm FROM lineitem)
SELECT l_orderkey, max(n - nm)::BIGINT AS best, count(*) AS alternatives FROM x GROUP BY l_orderkey""")
def xa_best(spark, sf):
    from ..operators.evaluate import match_score
    from ..sources.reads import alternatives

    l = table(spark, sf, "lineitem")
    entry = F.concat(F.lit("chr"), F.col("l_linenumber"), F.lit(",-"), F.col("l_partkey"), F.lit(","), F.col("l_partkey") % 97 + 5, F.lit("M,"), F.col("l_suppkey") % 6)
    xa = l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(entry), ";").alias("xa"))
    each = xa.select("l_orderkey", F.explode(alternatives(F.col("xa"))).alias("a"))
    return each.groupBy("l_orderkey").agg(F.max(match_score(F.col("a.cigar"), F.col("a.nm"))).cast("long").alias("best"), F.count(F.lit(1)).alias("alternatives"))


@query("f16_base_score", f"WITH {BENCH}, p AS (SELECT substr(seq, i, 1) AS a, substr(seq, i + 1, 1) AS b FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM s) x) SELECT a, b, count(*) AS pairs, CASE WHEN a = b OR a = 'N' OR b = 'N' THEN 1 ELSE -1 END AS score FROM p GROUP BY a, b")
def base_scores(spark, sf):
    """Scores of the benchmark's neighbouring bases."""
    s = sequences(spark, sf, "benchmark", "item_id").filter(F.length("seq") > 1)
    at = s.select("seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 1)).alias("i"))
    base = lambda i: F.col("seq").substr(i, F.lit(1))
    pairs = at.groupBy(base(F.col("i")).alias("a"), base(F.col("i") + 1).alias("b")).agg(F.count(F.lit(1)).alias("pairs"))
    return pairs.select("a", "b", "pairs", S.base_score(F.col("a"), F.col("b")).alias("score"))


@query("f17_relative_score", f"WITH {BENCH} SELECT item_id, length(seq)::BIGINT AS max_score, (length(replace(seq, 'N', '')) / length(seq))::FLOAT AS relative FROM s WHERE length(seq) > 0")
def relative_scores(spark, sf):
    s = F.col("seq")
    return sequences(spark, sf, "benchmark", "item_id").filter(F.length("seq") > 0).select("item_id", S.max_score(s).cast("long").alias("max_score"), S.relative_score(F.length(F.replace(s, F.lit("N"), F.lit(""))), s).alias("relative"))


@query("f18_expected_coverage", "SELECT l_orderkey, l_linenumber, round(greatest(0, 120.0::DOUBLE / 40.0::DOUBLE * (40.0::DOUBLE - l_quantity + 1)), 9) AS expected, round(greatest(0, 3.0::DOUBLE * (41.0::DOUBLE - l_quantity) * pow(0.995::DOUBLE, l_quantity)), 9) AS thinned FROM lineitem")
def expected_coverages(spark, sf):
    l = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return l.select("l_orderkey", "l_linenumber", F.round(stats.expected_coverage(F.lit(120.0), F.lit(40.0), q), 9).alias("expected"), F.round(stats.expected_coverage(F.lit(120.0), F.lit(40.0), q, True), 9).alias("thinned"))


@query("f19_alignment_info", """SELECT event_id, 'A(' || CASE WHEN value > 50 THEN '1' ELSE '0' END || ')A' || chr(9) || 'S(' || (event_id % 300) || ')S' || chr(9) || 'B(' || CASE WHEN event_id % 5 = 0 THEN '1' ELSE '0' END || ')B' || chr(9) || 'P(' || (event_id % 17) || ' ' || (user_id % 19) || ')P' || chr(9) || 'C(' || CASE WHEN value > 50 THEN (event_id % 7) || ' -' || (user_id % 11 + 1) ELSE '0' END || ')C' AS info FROM events""")
def alignment_infos(spark, sf):
    e = table(spark, sf, "events")
    chain = F.array((F.col("event_id") % 7).cast("int"), (-(F.col("user_id") % 11 + 1)).cast("int"))
    return e.select("event_id", alignment_info(F.col("value") > 50, F.col("event_id") % 300, F.col("event_id") % 5 == 0, F.col("event_id") % 17, F.col("user_id") % 19, chain).alias("info"))


@query("s18_ncf_roundtrip", "SELECT event_id, value > 50 AS aligned, (event_id % 300)::INTEGER AS score, event_id % 5 = 0 AS branch, (event_id % 17)::INTEGER AS pos_first, (user_id % 19)::INTEGER AS pos_last, CASE WHEN value > 50 THEN (event_id % 7) || ' -' || (user_id % 11 + 1) ELSE '0' END AS chain FROM events")
def ncf_roundtrip(spark, sf):
    lines = alignment_infos(spark, sf).select(F.concat_ws("\t", F.concat(F.lit("@r"), "event_id"), "info").alias("value"))
    back = sinks.parse_alignments(lines)
    return back.select(F.substring("header", 3, 30).cast("long").alias("event_id"), "aligned", "score", "branch", "pos_first", "pos_last", F.array_join(F.col("chain").cast("array<string>"), " ").alias("chain"))


@query("p14_header_tags", "SELECT event_id, event_id % 5 = 0 AS branch, CASE WHEN value > 50 THEN 2 ELSE 1 END::BIGINT AS nodes FROM events")
def header_tags(spark, sf):
    e = alignment_infos(spark, sf)
    return e.select("event_id", (tag(F.col("info"), "B") == "1").alias("branch"), F.size(chain_of(tag(F.col("info"), "C"))).cast("long").alias("nodes"))


@query("f20_same_read", "SELECT conv_id, count(*) AS rows, count(*) FILTER (WHERE turn % 2 = 0) AS same FROM conversations GROUP BY conv_id")
def same_reads(spark, sf):
    c = table(spark, sf, "conversations")
    a = F.concat(F.lit("@c"), "conv_id", F.lit("/1 x"))
    b = F.concat(F.lit("@c"), F.col("conv_id") + F.when(F.col("turn") % 2 == 0, 0).otherwise(1), F.lit("/2"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same_read(a, b)).alias("same"))


@query("f21_expected_multiplicity", "SELECT p_partkey, round(p_retailprice / p_size)::BIGINT AS multiplicity FROM part")
def expected_multiplicities(spark, sf):
    return table(spark, sf, "part").select("p_partkey", stats.expected_multiplicity(F.col("p_retailprice"), F.col("p_size")).cast("long").alias("multiplicity"))


@query("f22_trim_mask", "SELECT item_id, regexp_replace(trim(text), '[^ACGTacgt]', '~', 'g') AS masked FROM benchmark")
def trim_mask(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.regexp_replace(F.trim("text"), "[^ACGTacgt]", "~").alias("masked"))


# ---- k-mers ----


@query("p01_short_reads", f"WITH {DOCS} SELECT count(*) AS reads, count(*) FILTER (WHERE length(seq) < 101) AS short, count(*) FILTER (WHERE length(seq) >= 101) AS kept FROM s")
def short_reads(spark, sf):
    n = F.length("seq")
    return sequences(spark, sf).agg(F.count(F.lit(1)).alias("reads"), F.count_if(n < 101).alias("short"), F.count_if(n >= 101).alias("kept"))


@query("p02_valid_windows", f"WITH {DOCS}, {Q.kmers('doc_id')}, c AS (SELECT doc_id, count(*) AS valid FROM km GROUP BY doc_id) SELECT s.doc_id, greatest(length(seq) - {K - 1}, 0)::BIGINT AS windows, coalesce(valid, 0)::BIGINT AS valid FROM s LEFT JOIN c ON s.doc_id = c.doc_id")
def valid_windows(spark, sf):
    s = sequences(spark, sf)
    c = kmers.kmer_rows(s, K, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("valid"))
    return s.join(c, "doc_id", "left").select("doc_id", F.greatest(F.length("seq") - (K - 1), F.lit(0)).cast("long").alias("windows"), F.coalesce("valid", F.lit(0)).cast("long").alias("valid"))


@query("kmer_abundance", f"WITH {DOCS}, {Q.kmers('doc_id')} SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1 HAVING count(*) >= 2")
def kmer_abundance(spark, sf):
    return kmers.kmer_counts(sequences(spark, sf), K, 2)


@query("a01_kmer_table_k31", f"WITH {DOCS}, {Q.kmers('doc_id', 31)} SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1 HAVING count(*) >= 3")
def kmer_table_k31(spark, sf):
    return kmers.kmer_counts(sequences(spark, sf), 31, 3)


@query("a01_kmer_table_k63", f"WITH {DOCS}, {Q.kmers('doc_id', 63)} SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1")
def kmer_table_k63(spark, sf):
    """Codes of two longs."""
    return kmers.kmer_counts(sequences(spark, sf), 63)


@query("a03_overlap_mask_k63", f"WITH {DOCS}, {Q.overlaps('doc_id', 63)} SELECT canon, n, bf::INTEGER AS bf FROM ov")
def overlap_mask_k63(spark, sf):
    return kmers.overlap_table(sequences(spark, sf), 63).select("canon", "n", F.col("bf").cast("int").alias("bf"))


COUNTS = f"{DOCS}, {Q.kmers('doc_id')}, kc AS (SELECT {Q.canon('kmer')} AS canon, count(*) AS n FROM km GROUP BY 1)"


@query("a02_kmer_totals", f"WITH {COUNTS} SELECT count(*) AS distinct_kmers, coalesce(sum(n), 0)::BIGINT AS total_kmers, count(*) FILTER (WHERE n > 1) AS repeated_kmers FROM kc")
def kmer_totals(spark, sf):
    return kmers.kmer_totals(kmers.kmer_counts(sequences(spark, sf), K))


@query("a08_kmer_spectrum", f"WITH {COUNTS} SELECT least(n, 65535)::BIGINT AS multiplicity, count(*) AS kmers FROM kc GROUP BY 1")
def kmer_spectrum(spark, sf):
    return kmers.spectrum(kmers.kmer_counts(sequences(spark, sf), K))


@query("a03_overlap_mask", f"WITH {DOCS}, {Q.overlaps('doc_id')} SELECT canon, n, bf::INTEGER AS bf FROM ov")
def overlap_mask(spark, sf):
    return kmers.overlap_table(sequences(spark, sf), K).select("canon", "n", F.col("bf").cast("int").alias("bf"))


@query("p04_surviving_masks", f"""WITH {DOCS}, {Q.overlaps('doc_id')}, kept AS (SELECT * FROM ov WHERE n >= 3),
nb AS (SELECT canon, bit, CASE WHEN side = 'l' THEN base || substr(canon, 1, {K - 1}) ELSE substr(canon, 2) || base END AS kmer FROM kept
  JOIN (VALUES ('A','l',128),('C','l',64),('G','l',32),('T','l',16),('A','r',8),('C','r',4),('G','r',2),('T','r',1)) v(base, side, bit) ON (bf & bit) <> 0),
al AS (SELECT nb.canon, bit_or(bit) AS bf FROM nb JOIN kept k ON k.canon = {Q.canon('nb.kmer')} GROUP BY 1)
SELECT kept.canon, kept.n, coalesce(al.bf, 0)::INTEGER AS bf FROM kept LEFT JOIN al ON kept.canon = al.canon""")
def surviving_masks(spark, sf):
    return kmers.overlap_table(sequences(spark, sf), K, 3).select("canon", "n", F.col("bf").cast("int").alias("bf"))


@query("j04_branching_kmers", f"WITH {DOCS}, {Q.overlaps('doc_id')} SELECT canon, bit_count((bf & 240)::INTEGER)::INTEGER AS left_degree, bit_count((bf & 15)::INTEGER)::INTEGER AS right_degree FROM ov WHERE bit_count((bf & 240)::INTEGER) > 1 OR bit_count((bf & 15)::INTEGER) > 1")
def branching(spark, sf):
    return graph.branching_kmers(kmers.overlap_table(sequences(spark, sf), K))


@query("a04_library_stats", f"WITH {Q.seqs('documents', 'source')} SELECT source, count(*) AS num_reads, round(avg(length(seq)), 6) AS avg_read_len, max(length(seq))::BIGINT AS max_read_len FROM s GROUP BY source")
def library_stats(spark, sf):
    from ..sources.reads import library_stats as stats_of

    s = stats_of(sequences(spark, sf, "documents", "source").withColumnRenamed("seq", "read"), ["source"])
    return s.select("source", "num_reads", F.round("avg_read_len", 6).alias("avg_read_len"), F.col("max_read_len").cast("long").alias("max_read_len"))


@query("a07_graph_size", f"WITH {DOCS} SELECT sum(greatest(length(seq) - {K - 1}, 0))::BIGINT AS graph_size FROM s")
def graph_size(spark, sf):
    return sequences(spark, sf).agg(F.sum(F.greatest(S.marginal_length(F.col("seq"), K), F.lit(0))).cast("long").alias("graph_size"))


@query("w04_n50", f"WITH {DOCS}, l AS (SELECT length(seq)::BIGINT AS l, sum(length(seq)) AS b FROM s GROUP BY 1), r AS (SELECT l, sum(b) OVER (ORDER BY l) AS s, sum(b) OVER () AS t FROM l) SELECT min(l) AS n50 FROM r WHERE 2 * s >= t")
def n50_query(spark, sf):
    return graph.n50(sequences(spark, sf).select(F.length("seq").alias("len")))


@query("w10_text_offsets", f"WITH {DOCS}, o AS (SELECT row_number() OVER (ORDER BY doc_id) AS node_id, 2 * length(seq) + 2 AS c FROM s) SELECT node_id, (sum(c) OVER (ORDER BY node_id) - c)::BIGINT AS start FROM o")
def text_offsets(spark, sf):
    from ..session import numbered

    n = numbered(sequences(spark, sf), ["doc_id"], "node_id").select("node_id", F.length("seq").alias("len"))
    return graph.text_offsets(materialise(n, "lengths")).select("node_id", F.col("start").cast("long").alias("start"))


@query("j05_range_locate", f"""WITH {DOCS}, o AS (SELECT row_number() OVER (ORDER BY doc_id) AS node_id, 2 * length(seq) + 2 AS c FROM s),
p AS (SELECT node_id, (sum(c) OVER (ORDER BY node_id) - c)::BIGINT AS start, sum(c) OVER (ORDER BY node_id)::BIGINT AS e FROM o),
q AS (SELECT event_id, event_id * 61 AS position FROM events)
SELECT event_id, node_id, (position - start)::BIGINT AS within FROM q JOIN p ON position >= start AND position < e""")
def range_locate(spark, sf):
    from ..session import numbered

    n = materialise(numbered(sequences(spark, sf), ["doc_id"], "node_id").select("node_id", F.length("seq").alias("len")), "lengths")
    slots = graph.text_offsets(n).join(n, "node_id").select("node_id", "start", (F.col("start") + 2 * F.col("len") + 2).alias("end"))
    points = table(spark, sf, "events").select("event_id", (F.col("event_id") * 61).alias("position"))
    return seeds.located(points, slots).select("event_id", "node_id", (F.col("position") - F.col("start")).cast("long").alias("within"))


@query("j01_unmatched_reads", f"""WITH {BENCH}, {Q.kmers('item_id')}, {Q.seqs('documents', 'doc_id', 'd')}, {Q.kmers('doc_id', K, 'd', 'dk')}, kc AS (SELECT DISTINCT {Q.canon('kmer')} AS canon FROM dk)
SELECT item_id, count(*) AS unmatched FROM km WHERE {Q.canon('kmer')} NOT IN (SELECT canon FROM kc) GROUP BY item_id""")
def unmatched_reads(spark, sf):
    rows = kmers.canonical_rows(sequences(spark, sf, "benchmark", "item_id"), K, ["item_id"])
    known = kmers.known_codes(rows, sequences(spark, sf), K)
    return rows.join(known, "canon", "left_anti").groupBy("item_id").agg(F.count(F.lit(1)).alias("unmatched"))


LOOKUP = f"""{BENCH}, {Q.kmers('item_id')}, {Q.seqs('documents', 'doc_id', 'd')}, {Q.kmers('doc_id', K, 'd', 'dk')},
ix AS (SELECT {Q.canon('kmer')} AS canon, CASE WHEN {Q.turned('kmer')} THEN -(doc_id + 1) ELSE doc_id + 1 END AS node, CASE WHEN {Q.turned('kmer')} THEN length(seq) - {K} - pos ELSE pos END AS pos, length(seq) - {K - 1} AS ml FROM dk),
hit AS (SELECT item_id, a.pos AS rpos, CASE WHEN {Q.turned('a.kmer')} THEN -node ELSE node END AS node, CASE WHEN {Q.turned('a.kmer')} THEN ml - 1 - ix.pos ELSE ix.pos END AS npos FROM km a JOIN ix ON ix.canon = {Q.canon('a.kmer')})"""


def document_nodes(spark, sf):
    s = sequences(spark, sf)
    return s.select((F.col("doc_id") + 1).alias("node_id"), "seq", S.marginal_length(F.col("seq"), K).alias("marg_len"))


def document_hits(spark, sf):
    index = seeds.kmer_index(document_nodes(spark, sf), K)
    return seeds.lookup(sequences(spark, sf, "benchmark", "item_id"), index, K, "item_id")


@query("j02_kmer_index_lookup", f"WITH {LOOKUP} SELECT item_id, rpos, node, npos AS pos FROM hit")
def kmer_index_lookup(spark, sf):
    h = document_hits(spark, sf)
    return h.select("item_id", F.col("rpos").cast("long").alias("rpos"), F.col("node").cast("long").alias("node"), F.col("pos").cast("long").alias("pos"))


def document_islands(spark, sf):
    """Islands of each (read, node) pair: a k-mer may lie in many documents."""
    h = document_hits(spark, sf).withColumn("key", F.struct("item_id", "node", (F.col("pos") - F.col("rpos")).alias("diag")))
    return seeds.islands(h, None, "key").select(F.col("key.item_id").alias("item_id"), "chain", "node_first", "read_first", "read_end")


# a gap of invalid or missing k-mers doesn't end an island on one diagonal
ISLANDS = f"{LOOKUP}, isl AS (SELECT item_id, node, min(npos) AS node_first, min(rpos) AS read_first, max(rpos) + 1 AS read_end FROM hit GROUP BY item_id, node, npos - rpos)"


@query("w03_seed_islands", f"WITH {ISLANDS} SELECT item_id, node::BIGINT AS node, node_first::BIGINT AS node_first, read_first::BIGINT AS read_first, read_end::BIGINT AS read_end FROM isl")
def seed_islands(spark, sf):
    s = document_islands(spark, sf)
    return s.select("item_id", F.col("chain")[0].cast("long").alias("node"), *[F.col(c).cast("long").alias(c) for c in ("node_first", "read_first", "read_end")])


@query("w06_merged_seeds", f"WITH {ISLANDS} SELECT item_id, count(*) AS seeds, sum(read_end - read_first)::BIGINT AS kmers FROM isl GROUP BY item_id")
def merged_seed_query(spark, sf):
    m = seeds.merged_seeds(document_islands(spark, sf), "item_id")
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("seeds"), F.sum(F.col("read_end") - F.col("read_first")).cast("long").alias("kmers"))


TOP = f"{ISLANDS}, tp AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY read_end - read_first DESC, read_first, node, node_first) AS seed_rank FROM isl)"


@query("w07_top_seeds", f"WITH {TOP} SELECT item_id, seed_rank, node::BIGINT AS node, read_first::BIGINT AS read_first, (read_end - least({K - 1}, read_end - read_first - 1))::BIGINT AS read_end FROM tp WHERE seed_rank <= 10")
def top_seed_query(spark, sf):
    t = seeds.top_seeds(document_islands(spark, sf), 10, "item_id", K)
    return t.select("item_id", F.col("seed_rank").cast("long").alias("seed_rank"), F.col("chain")[0].cast("long").alias("node"), F.col("read_first").cast("long").alias("read_first"), F.col("read_end").cast("long").alias("read_end"))


@query("w08_best_candidate", f"WITH {TOP}, m AS (SELECT item_id, max(read_end - read_first) AS top FROM tp GROUP BY item_id) SELECT tp.item_id, node::BIGINT AS node, top::BIGINT AS score, (SELECT count(*) FROM tp t WHERE t.item_id = tp.item_id AND t.read_end - t.read_first = top)::BIGINT AS ties FROM tp JOIN m ON tp.item_id = m.item_id WHERE seed_rank = 1")
def best_candidate(spark, sf):
    t = seeds.top_seeds(document_islands(spark, sf), 1 << 30, "item_id").withColumn("score", F.col("read_end") - F.col("read_first"))
    return seeds.best_candidates(t, "item_id").select("item_id", F.col("chain")[0].cast("long").alias("node"), F.col("score").cast("long").alias("score"), F.col("ties").cast("long").alias("ties"))


MEMS = f"""{BENCH}, {Q.kmers('item_id', 16)}, {Q.seqs('documents', 'doc_id', 'd')}, d2 AS (SELECT doc_id + 1 AS node, seq FROM d UNION ALL SELECT -(doc_id + 1), {Q.rc('seq')} FROM d), {Q.kmers('node', 16, 'd2', 'dk')},
mh AS (SELECT item_id, node, a.pos AS rpos, b.pos AS npos FROM km a JOIN dk b ON a.kmer = b.kmer),
mr AS (SELECT *, rpos - row_number() OVER (PARTITION BY item_id, node, npos - rpos ORDER BY rpos) AS run FROM mh),
mm AS (SELECT item_id, node, min(npos) AS node_first, min(rpos) AS read_first, count(*) + 15 AS length FROM mr GROUP BY item_id, node, npos - rpos, run)"""


def mems(spark, sf):
    return seeds.exact_matches(sequences(spark, sf, "benchmark", "item_id"), document_nodes(spark, sf), 16, "item_id")


@query("j15_mem_seeds", f"WITH {MEMS} SELECT item_id, node::BIGINT AS node, node_first::BIGINT AS node_first, read_first::BIGINT AS read_first, length::BIGINT AS length FROM mm")
def mem_seed_query(spark, sf):
    return mems(spark, sf).select("item_id", *[F.col(c).cast("long").alias(c) for c in ("node", "node_first", "read_first", "length")])


@query("j16_mum_seeds", f"WITH {MEMS}, t AS (SELECT mm.*, substr(s.seq, read_first + 1, length) AS text FROM mm JOIN s ON mm.item_id = s.item_id), u AS (SELECT text FROM (SELECT DISTINCT text, node, node_first FROM t) x GROUP BY text HAVING count(*) = 1), v AS (SELECT text FROM (SELECT DISTINCT text, item_id, read_first FROM t) x GROUP BY text HAVING count(*) = 1) SELECT item_id, node::BIGINT AS node, read_first::BIGINT AS read_first, length::BIGINT AS length FROM t WHERE text IN (SELECT text FROM u) AND text IN (SELECT text FROM v)")
def mum_seed_query(spark, sf):
    reads = sequences(spark, sf, "benchmark", "item_id")
    u = seeds.unique_matches(materialise(mems(spark, sf), "mems"), reads, "item_id")
    return u.select("item_id", F.col("node").cast("long").alias("node"), F.col("read_first").cast("long").alias("read_first"), F.col("length").cast("long").alias("length"))


@query("o10_adaptive_mems", f"WITH {MEMS}, c AS (SELECT item_id, least(length, {K - 1}) AS l, count(*) AS n FROM mm GROUP BY 1, 2), r AS (SELECT item_id, l, sum(n) OVER (PARTITION BY item_id ORDER BY l DESC) AS s FROM c), k AS (SELECT item_id, max(l) AS cut FROM r WHERE s >= 100 GROUP BY item_id) SELECT mm.item_id, count(*) AS kept, min(length)::BIGINT AS least FROM mm LEFT JOIN k ON mm.item_id = k.item_id WHERE cut IS NULL OR length >= cut GROUP BY mm.item_id")
def adaptive_mems(spark, sf):
    a = seeds.adaptive_matches(materialise(mems(spark, sf), "mems"), K, "item_id")
    return a.groupBy("item_id").agg(F.count(F.lit(1)).alias("kept"), F.min("length").cast("long").alias("least"))


@query("p09_mem_borders", f"WITH {MEMS} SELECT mm.item_id, count(*) AS inside FROM mm JOIN d ON d.doc_id + 1 = abs(mm.node) JOIN s ON s.item_id = mm.item_id WHERE node_first < length(d.seq) - {K - 1} AND read_first < length(s.seq) - {K - 1} GROUP BY mm.item_id")
def mem_borders(spark, sf):
    reads = sequences(spark, sf, "benchmark", "item_id").select("item_id", S.marginal_length(F.col("seq"), K).alias("read_marg"))
    nodes = document_nodes(spark, sf)
    lengths = nodes.select(F.col("node_id").alias("node"), "marg_len").unionByName(nodes.select((-F.col("node_id")).alias("node"), "marg_len"))
    return seeds.match_seeds(mems(spark, sf), lengths, reads, K, "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("inside"))


@query("j18_find_pattern", f"WITH {DOCS} SELECT doc_id + 1 AS node_id, instr(seq, 'ACGTAC')::INTEGER AS at FROM s WHERE instr(seq, 'ACGTAC') > 0")
def find_pattern(spark, sf):
    return seeds.find_pattern(document_nodes(spark, sf), "ACGTAC")


@query("l17_seed_places", f"WITH {ISLANDS} SELECT item_id, count(*) AS places, sum(rp)::BIGINT AS rpos_sum FROM (SELECT item_id, unnest(range(read_first, read_end)) AS rp FROM isl) x GROUP BY item_id")
def seed_place_query(spark, sf):
    p = seeds.seed_places(document_islands(spark, sf), "item_id")
    return p.groupBy("item_id").agg(F.count(F.lit(1)).alias("places"), F.sum("rpos").cast("long").alias("rpos_sum"))


@query("u01_union_libraries", "SELECT lib_id, count(*) AS num_reads, sum(length(text))::BIGINT AS chars FROM (SELECT 0 AS lib_id, text FROM documents UNION ALL SELECT 1, html FROM pages UNION ALL SELECT 2, text FROM benchmark) x GROUP BY lib_id")
def union_libraries(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(i).alias("lib_id"), F.col(c).alias("text")) for i, (t, c) in enumerate((("documents", "text"), ("pages", "html"), ("benchmark", "text")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lib_id").agg(F.count(F.lit(1)).alias("num_reads"), F.sum(F.length("text")).alias("chars"))


@query("u02_distinct_reads", f"WITH {DOCS} SELECT DISTINCT md5(seq) AS seq_md5 FROM s")
def distinct_reads(spark, sf):
    return sequences(spark, sf).select(F.md5("seq").alias("seq_md5")).distinct()


@query("s08_fasta_wrap", f"WITH {BENCH} SELECT item_id, ceil(length(seq) / 70.0)::BIGINT AS lines, (length(seq) + ceil(length(seq) / 70.0) - 1)::BIGINT AS chars FROM s WHERE length(seq) > 0")
def fasta_wrap(spark, sf):
    w = sequences(spark, sf, "benchmark", "item_id").filter(F.length("seq") > 0).select("item_id", sinks.wrapped(F.col("seq")).alias("w"))
    return w.select("item_id", F.size(F.split("w", "\n")).cast("long").alias("lines"), F.length("w").cast("long").alias("chars"))


def _pairs(spark, sf):
    """Each whole sequence and itself without its 21st base."""
    b = sequences(spark, sf, "benchmark", "item_id")
    return b.select("item_id", F.col("seq").alias("a"), F.concat(F.substring("seq", 1, 20), F.substring("seq", 22, 1 << 30)).alias("b"))


def _next_pairs(spark, sf):
    """Each whole sequence and the next item's; the last item has none, and null scores."""
    b = sequences(spark, sf, "benchmark", "item_id")
    return b.select("item_id", F.col("seq").alias("a")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("b")), "item_id", "left")


SELF_PAIRS = f"{BENCH}, pr AS (SELECT item_id, seq AS a, substr(seq, 1, 20) || substr(seq, 22) AS b, length(seq) AS n, length(substr(seq, 1, 20) || substr(seq, 22)) AS m FROM s)"
NEXT_PAIRS = f"{BENCH}, pr AS (SELECT x.item_id, x.seq AS a, y.seq AS b, length(x.seq) AS n, length(y.seq) AS m FROM s x LEFT JOIN s y ON y.item_id = x.item_id + 1)"
LAST_CELL = "FROM pr LEFT JOIN dp ON dp.item_id = pr.item_id AND d = n + m"


@query("l01_nw_score", f"WITH RECURSIVE {NEXT_PAIRS}, {Q.diagonals()} SELECT pr.item_id, p1[n + 1] AS score {LAST_CELL}")
def nw_scores(spark, sf):
    return _next_pairs(spark, sf).select("item_id", nw_score("a", "b").alias("score"))


@query("l03_banded_score", f"WITH RECURSIVE {SELF_PAIRS}, {Q.diagonals(band=3)} SELECT pr.item_id, p1[n + 1] AS score {LAST_CELL}")
def banded_scores(spark, sf):
    return _pairs(spark, sf).select("item_id", nw_banded(3)("a", "b").alias("score"))


@query("l04_free_end_score", f"WITH RECURSIVE {NEXT_PAIRS}, {Q.diagonals(free=True)}, en AS (SELECT pr.item_id, max(greatest(CASE WHEN d >= n THEN p1[n + 1] END, CASE WHEN d BETWEEN m AND n + m THEN p1[d - m + 1] END)) AS score FROM pr JOIN dp ON dp.item_id = pr.item_id GROUP BY 1) SELECT pr.item_id, CASE WHEN b IS NOT NULL THEN score END AS score FROM pr LEFT JOIN en ON en.item_id = pr.item_id")
def free_end_scores(spark, sf):
    return _next_pairs(spark, sf).select("item_id", free_score("a", "b").alias("score"))


@query("l18_match_count", f"WITH RECURSIVE {NEXT_PAIRS}, {Q.diagonals(1, 0, 0)} SELECT pr.item_id, p1[n + 1] AS common {LAST_CELL}")
def match_count(spark, sf):
    return _next_pairs(spark, sf).select("item_id", lcs_score("a", "b").alias("common"))


@query("a13_mixture_fit")
def mixture_fit(spark, sf):
    """EM on the k-mer spectrum (65,535 rows at most), with its cut-off and genome size."""
    rows = kmers.spectrum(kmers.kmer_counts(sequences(spark, sf), K)).orderBy("multiplicity").collect()
    fit = stats.fit_mixture([r["multiplicity"] for r in rows], [r["kmers"] for r in rows], [1.0, 2.0, 6.0, 12.0])
    cut, size = stats.coverage_cutoff(fit, 2), stats.genome_size(fit, sum(r["kmers"] for r in rows), 2)
    return spark.createDataFrame([(c["component"], c["mu"], c["var"], c["share"], cut, size) for c in fit], "component int, mu double, var double, share double, cutoff int, genome_size long")
