"""Queries on node paths (from events, conversations) and on evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains as C
from ..operators import evaluate, markov
from ..session import table
from . import sqltext as Q
from .registry import query
from .tables import chain_arcs, event_chains, sequences

ORDERS = (2, 3, 4)


def text(c: str):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query("p10_chain_lengths", f"WITH {Q.CHAINS} SELECT count(*) AS chains, count(*) FILTER (WHERE len(chain) >= 2) AS usable, count(*) FILTER (WHERE len(chain) >= 3) AS trainable FROM ch")
def chain_lengths(spark, sf):
    n = F.size("chain")
    return event_chains(spark, sf).agg(F.count(F.lit(1)).alias("chains"), F.count_if(n >= 2).alias("usable"), F.count_if(n >= 3).alias("trainable"))


TRANS = f"{Q.CHAINS}, {Q.grams(ORDERS)}, tr AS (SELECT ord, chain, next_node, count(*) AS freq FROM gr GROUP BY ALL)"


@query("a10_markov_ngrams", f"WITH {TRANS} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq FROM tr")
def markov_ngrams(spark, sf):
    return markov.transitions(event_chains(spark, sf), ORDERS).select("ord", text("chain").alias("chain"), "next_node", "freq")


@query("j14_merged_tables", f"WITH {TRANS} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq::BIGINT AS freq FROM tr")
def merged_tables(spark, sf):
    c = event_chains(spark, sf)
    halves = [markov.transitions(c.filter(F.col("user_id") % 2 == i), ORDERS) for i in (0, 1)]
    return markov.merged(halves).select("ord", text("chain").alias("chain"), "next_node", "freq")


@query("a20_conditional", f"WITH {TRANS} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq, (sum(freq) OVER (PARTITION BY ord, chain))::BIGINT AS total, round(freq / sum(freq) OVER (PARTITION BY ord, chain), 9) AS probability FROM tr")
def conditional(spark, sf):
    t = markov.conditional(markov.transitions(event_chains(spark, sf), ORDERS))
    return t.select("ord", text("chain").alias("chain"), "next_node", "freq", "total", F.round("probability", 9).alias("probability"))


@query("p11_branching_only", f"WITH {TRANS}, {Q.ARCS}, b AS (SELECT src FROM ea GROUP BY 1 HAVING count(*) > 9) SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq FROM tr WHERE chain[-1] IN (SELECT src FROM b)")
def branching_only(spark, sf):
    c = event_chains(spark, sf)
    b = chain_arcs(c).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 9")
    return markov.transitions(c, ORDERS, branching=b).select("ord", text("chain").alias("chain"), "next_node", "freq")


# path lengths for the decisions: node n is 10 * |n| k-mers long, k = 21
LEN_SQL = "22 + list_sum(list_transform(chain[2:], lambda v: 10 * abs(v)))"
DECIDED = f"""{TRANS}, le AS (SELECT *, ({LEN_SQL})::DOUBLE AS avg_len FROM tr),
ex AS (SELECT *, greatest(0, 11.0::DOUBLE / 400.0::DOUBLE * (400.0::DOUBLE - avg_len + 1)) AS expected FROM le),
od AS (SELECT *, CASE WHEN expected > 0 THEN (freq * (ln(1.0::DOUBLE) - ln(expected)) - 1 + expected) / ln(10.0::DOUBLE) END AS odds FROM ex),
de AS (SELECT *, NOT coalesce(expected >= 10 AND odds > 5 AND freq < expected, FALSE) AS accepted FROM od)"""


def decided(spark, sf):
    t = markov.transitions(event_chains(spark, sf), ORDERS)
    nodes = spark.range(1, 6).select(F.col("id").cast("int").alias("node_id"), (F.col("id") * 10).alias("marg_len"))
    return markov.decide(markov.with_lengths(t, nodes, 21), 11.9, 400.5)


@query("m03_chain_lengths", f"WITH {TRANS} SELECT ord, {Q.join_text('chain')} AS chain, next_node, ({LEN_SQL})::DOUBLE AS avg_len FROM tr")
def path_lengths(spark, sf):
    return decided(spark, sf).select("ord", text("chain").alias("chain"), "next_node", "avg_len")


@query("m04_markov_decisions", f"WITH {DECIDED} SELECT ord, {Q.join_text('chain')} AS chain, next_node, freq, round(expected, 9) AS expected, round(odds, 6) AS odds, accepted FROM de")
def markov_decisions(spark, sf):
    return decided(spark, sf).select("ord", text("chain").alias("chain"), "next_node", "freq", F.round("expected", 9).alias("expected"), F.round("odds", 6).alias("odds"), "accepted")


PROP = f"""{DECIDED}, s2 AS (SELECT chain FROM de WHERE ord = 2 AND accepted GROUP BY chain HAVING count(*) = 1),
p2 AS (SELECT * FROM de WHERE ord = 2 OR chain[-2:] NOT IN (SELECT chain FROM s2)),
s3 AS (SELECT chain FROM p2 WHERE ord = 3 AND accepted GROUP BY chain HAVING count(*) = 1),
p3 AS (SELECT * FROM p2 WHERE ord <= 3 OR chain[-3:] NOT IN (SELECT chain FROM s3))"""


@query("m05_markov_propagate", f"WITH {PROP} SELECT ord, {Q.join_text('chain')} AS chain, next_node, accepted FROM p3")
def markov_propagate(spark, sf):
    return markov.propagate(decided(spark, sf), ORDERS).select("ord", text("chain").alias("chain"), "next_node", "accepted")


@query("j12_suffix_join", f"WITH {DECIDED} SELECT count(*) AS rows FROM de WHERE ord > 2 AND chain[-2:] IN (SELECT chain FROM de WHERE ord = 2 AND NOT accepted)")
def suffix_join(spark, sf):
    d = decided(spark, sf)
    return markov.ending_in(d.filter("ord > 2"), d.filter(~F.col("accepted")), 2, "left_semi").agg(F.count(F.lit(1)).alias("rows"))


PLACES = "q AS (SELECT user_id, i AS place, chain[i - 3:i] AS chain FROM (SELECT user_id, chain, unnest(range(4, len(chain) + 1)) AS i FROM ch) x)"


def _places(c: DataFrame) -> DataFrame:
    """The last four nodes at every place of every chain from the fourth on."""
    places = c.filter(F.size("chain") >= 4).select("user_id", "chain", F.explode(F.sequence(F.lit(4).cast("long"), F.size("chain").cast("long"))).alias("place"))
    return places.select("user_id", "place", F.slice("chain", F.col("place").cast("int") - 3, F.lit(4)).alias("chain"))


@query("j06_markov_backoff", f"WITH {TRANS}, fr AS (SELECT DISTINCT ord, chain FROM tr WHERE freq >= 3), {PLACES}, c AS (SELECT user_id, place, o AS ord, chain[-o:] AS chain FROM q, (VALUES (2), (3), (4)) v(o)), m AS (SELECT user_id, place, max(c.ord) AS ord FROM c JOIN fr ON c.ord = fr.ord AND c.chain = fr.chain GROUP BY 1, 2) SELECT m.user_id, m.place, m.ord, {Q.join_text('c.chain')} AS chain FROM m JOIN c ON m.user_id = c.user_id AND m.place = c.place AND m.ord = c.ord")
def markov_backoff(spark, sf):
    c = event_chains(spark, sf)
    t = markov.transitions(c, ORDERS).filter("freq >= 3")
    return markov.longest_context(_places(c), t, ["user_id", "place"], ORDERS).select("user_id", "place", "ord", text("chain").alias("chain"))


@query("m06_eligible_next", f"""WITH {DECIDED}, {Q.ARCS}, {PLACES},
c AS (SELECT user_id, place, o AS ord, chain[-o:] AS chain FROM q, (VALUES (2), (3), (4)) v(o)),
k AS (SELECT DISTINCT ord, chain FROM de), m AS (SELECT user_id, place, max(c.ord) AS ord FROM c JOIN k ON c.ord = k.ord AND c.chain = k.chain GROUP BY 1, 2),
x AS (SELECT m.user_id, m.place, m.ord, c.chain FROM m JOIN c ON m.user_id = c.user_id AND m.place = c.place AND m.ord = c.ord),
o AS (SELECT q.user_id, q.place, ea.dst AS next_node, count(*) OVER (PARTITION BY q.user_id, q.place) AS n FROM q JOIN ea ON ea.src = q.chain[-1])
SELECT o.user_id, o.place, o.next_node FROM o LEFT JOIN x ON o.user_id = x.user_id AND o.place = x.place WHERE x.user_id IS NULL OR o.n = 1 OR EXISTS (SELECT 1 FROM de WHERE de.ord = x.ord AND de.chain = x.chain AND de.next_node = o.next_node AND accepted)""")
def eligible_next(spark, sf):
    c = event_chains(spark, sf)
    return markov.eligible_next(_places(c), decided(spark, sf), chain_arcs(c), ["user_id", "place"], ORDERS)


@query("m07_contradicted", f"WITH {DECIDED}, w AS (SELECT user_id, o AS ord, chain[i:i + o - 1] AS chain, chain[i + o] AS next_node FROM (SELECT user_id, chain, o, unnest(range(1, len(chain) - o + 1)) AS i FROM ch, (VALUES (2), (3), (4)) v(o) WHERE len(chain) > o) x) SELECT user_id, count(*) AS steps FROM w WHERE EXISTS (SELECT 1 FROM de WHERE de.ord = w.ord AND de.chain = w.chain AND de.next_node = w.next_node AND NOT accepted) GROUP BY user_id")
def contradicted(spark, sf):
    bad = markov.contradicted(event_chains(spark, sf), decided(spark, sf), ["user_id"], ORDERS)
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"))


SHORT = f"{Q.CHAINS}, sh AS (SELECT user_id, i, chain[i:i + 2] AS chain FROM (SELECT user_id, chain, unnest(range(1, len(chain) - 1)) AS i FROM ch) x)"


def short_chains(spark, sf):
    c = F.col("chain")
    e = event_chains(spark, sf).filter(F.size("chain") >= 3)
    return e.select("user_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.slice(c, i, 3))).alias("i", "chain"))


@query("a09_chain_dedup", f"WITH {SHORT} SELECT {Q.join_text('least(chain, ' + Q.back('chain') + ')')} AS chain, count(*) AS n FROM sh GROUP BY 1")
def chain_dedup(spark, sf):
    return C.distinct_chains(short_chains(spark, sf)).select(text("chain").alias("chain"), "n")


@query("j11_chain_valid", f"WITH {Q.CHAINS}, a AS (SELECT a.node AS src, b.node AS dst FROM st a JOIN st b ON a.user_id = b.user_id AND b.p = a.p + 1 GROUP BY 1, 2 HAVING count(*) >= 60) SELECT DISTINCT x.user_id FROM st x JOIN st y ON x.user_id = y.user_id AND y.p = x.p + 1 WHERE (x.node, y.node) NOT IN (SELECT (src, dst) FROM a)")
def chain_valid(spark, sf):
    c = event_chains(spark, sf)
    ch = F.col("chain")
    pairs = c.filter(F.size(ch) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(ch) - 1), lambda i: F.struct(F.element_at(ch, i).alias("src"), F.element_at(ch, i + 1).alias("dst")))).alias("x")).select("x.*")
    arcs = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60")
    return C.invalid_chains(c, arcs, "user_id")


@query("j13_occurrences", f"WITH {Q.CHAINS}, w AS (SELECT user_id, i - 1 AS pos, chain[i:i + 1] AS c FROM (SELECT user_id, chain, unnest(range(1, len(chain))) AS i FROM ch) x) SELECT user_id, pos::INTEGER AS pos, c = [-2, -1] AS turned FROM w WHERE c = [1, 2] OR c = [-2, -1]")
def occurrences(spark, sf):
    return C.occurrences(event_chains(spark, sf), [1, 2], "user_id")


@query("j10_mates", "WITH a AS (SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations) SELECT x.conv_id, x.turn, x.n AS first_len, y.n AS second_len FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 WHERE x.turn % 2 = 0")
def mates(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.filter("turn % 2 = 0").select(F.struct("conv_id", "turn").alias("rec_id"), F.length("text").alias("chain"))
    second = c.filter("turn % 2 = 1").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("rec_id"), F.length("text").alias("chain"))
    m = C.mates(first, second)
    return m.select("rec_id.conv_id", "rec_id.turn", F.col("chain1").cast("long").alias("first_len"), F.col("chain2").cast("long").alias("second_len"))


@query("a16_chain_pairs", "WITH a AS (SELECT conv_id, turn, (length(text) % 50)::BIGINT AS idx, length(text) % 2 = 0 AS turned FROM conversations) SELECT x.idx AS idx1, x.turned AS turned1, y.idx AS idx2, y.turned AS turned2, count(*) AS n FROM a x JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1 GROUP BY ALL")
def chain_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 50).cast("long").alias("idx"), (F.length("text") % 2 == 0).alias("turned"))
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("idx").alias("idx2"), F.col("turned").alias("turned2"))
    return C.paired_links(c.withColumnsRenamed({"idx": "idx1", "turned": "turned1"}).join(y, ["conv_id", "turn"]))


BETWEEN = f"""{Q.CHAINS}, bo AS (SELECT chain FROM ch UNION ALL SELECT {Q.back('chain')} FROM ch),
w AS (SELECT chain[i:] AS rest FROM (SELECT chain, unnest(range(1, len(chain) + 1)) AS i FROM bo) x WHERE chain[i] = 1),
pa AS (SELECT rest[1:list_position(rest, 4)] AS path, count(*) AS n FROM w WHERE list_position(rest, 4) > 0 GROUP BY 1)"""


@query("g14_paths_between", f"WITH {BETWEEN} SELECT {Q.join_text('path')} AS path, n FROM pa")
def paths_between(spark, sf):
    return C.between(event_chains(spark, sf), 1, 4).select(text("path").alias("path"), "n")


@query("g14_consensus", f"WITH {BETWEEN}, v AS (SELECT i - 1 AS pos, path[i] AS node, sum(n) AS n FROM (SELECT path, n, unnest(range(1, len(path) + 1)) AS i FROM pa) x GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, node) AS rk, count(*) OVER (PARTITION BY pos) AS nodes FROM v) SELECT pos::INTEGER AS pos, nodes, node AS best FROM r WHERE rk = 1")
def consensus(spark, sf):
    return C.consensus(C.between(event_chains(spark, sf), 1, 4))


@query("g15_smooth", f"WITH {Q.CHAINS}, f AS (SELECT b.node AS nxt, count(*) AS n FROM st a JOIN st b ON a.user_id = b.user_id AND b.p = a.p + 1 WHERE a.node = 3 GROUP BY 1), b AS (SELECT nxt FROM f ORDER BY n DESC, nxt LIMIT 1), s2 AS (SELECT x.user_id, x.p, CASE WHEN y.node = 3 THEN (SELECT nxt FROM b) ELSE x.node END AS node FROM st x LEFT JOIN st y ON x.user_id = y.user_id AND y.p = x.p - 1) SELECT user_id, string_agg(node::VARCHAR, ' ' ORDER BY p) AS chain FROM s2 GROUP BY user_id")
def smooth(spark, sf):
    return C.smoothed(event_chains(spark, sf), 3).select("user_id", text("chain").alias("chain"))


@query("g15_rewrite", f"WITH {Q.CHAINS}, t AS (SELECT user_id, ' ' || {Q.join_text('chain')} || ' ' AS t FROM ch) SELECT user_id, trim(replace(replace(t, ' 1 2 3 ', ' 1 3 '), ' -3 -2 -1 ', ' -3 -1 ')) AS chain FROM t")
def rewrite(spark, sf):
    return C.reduced(event_chains(spark, sf), [1, 2, 3], [1, 3]).select("user_id", text("chain").alias("chain"))


@query("u03_allowed_arcs", f"WITH {Q.CHAINS}, {Q.ARCS} SELECT src, count(*) AS arcs, count(*) FILTER (WHERE dst NOT IN (2, 4)) AS remaining, count(*) FILTER (WHERE dst IN (2, 4)) AS allowed FROM ea GROUP BY src")
def allowed_arcs(spark, sf):
    g = chain_arcs(event_chains(spark, sf)).groupBy("src").agg(F.collect_set("dst").alias("d"))
    some = F.array(F.lit(2), F.lit(4))
    return g.select("src", F.size("d").cast("long").alias("arcs"), F.size(F.array_except("d", some)).cast("long").alias("remaining"), F.size(F.array_intersect("d", some)).cast("long").alias("allowed"))


# ---- evaluation ----

MUT = f"""{Q.seqs('benchmark', 'item_id')}, b AS (SELECT item_id, i, substr(seq, i, 1) AS p FROM (SELECT item_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM s) x),
m AS (SELECT item_id, i, p, CASE WHEN i % 37 = 0 THEN translate(p, 'ACGT', 'CGTA') ELSE p END AS w, CASE WHEN i % 74 = 0 OR i % 101 = 0 THEN translate(p, 'ACGT', 'GTAC') ELSE p END AS c FROM b),
r AS (SELECT item_id, count(*) FILTER (WHERE w <> p AND c = p) AS tp, count(*) FILTER (WHERE w = p AND c = p) AS tn, count(*) FILTER (WHERE w = p AND c <> p) AS fp, count(*) FILTER (WHERE w <> p AND c <> p) AS fn, count(*) FILTER (WHERE w = 'N') AS initial_n, count(*) FILTER (WHERE c = 'N') AS new_n, count(*) FILTER (WHERE w <> p) AS errors FROM m GROUP BY item_id)"""


def three_versions(spark, sf):
    s = sequences(spark, sf, "benchmark", "item_id")
    base = lambda i: F.col("seq").substr(i, F.lit(1))
    n = F.sequence(F.lit(1), F.length("seq"))
    wrong = F.array_join(F.transform(n, lambda i: F.when(i % 37 == 0, F.translate(base(i), "ACGT", "CGTA")).otherwise(base(i))), "")
    fixed = F.array_join(F.transform(n, lambda i: F.when((i % 74 == 0) | (i % 101 == 0), F.translate(base(i), "ACGT", "GTAC")).otherwise(base(i))), "")
    make = lambda c: s.select(F.col("item_id").alias("rec_id"), c.alias("read"))
    return make(wrong), make(F.col("seq")), make(fixed)


@query("e02_per_read", f"WITH {MUT} SELECT * FROM r")
def per_read(spark, sf):
    t = evaluate.three_reads(*three_versions(spark, sf))
    return evaluate.per_read(evaluate.aligned_triples(evaluate.comparable(t))).withColumnRenamed("rec_id", "item_id")


@query("a12_eval_confusion", f"""WITH {MUT} SELECT sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
count(*) FILTER (WHERE errors > 0 AND fp = 0 AND fn = 0) AS tp_full, count(*) FILTER (WHERE errors = 0 AND fp = 0 AND fn = 0) AS tn_full, count(*) FILTER (WHERE errors = 0 AND NOT (fp = 0 AND fn = 0)) AS fp_full, count(*) FILTER (WHERE errors > 0 AND NOT (fp = 0 AND fn = 0)) AS fn_full,
sum(initial_n)::BIGINT AS initial_n, sum(new_n)::BIGINT AS new_n, max(errors) AS max_errors, round(100.0::DOUBLE * (sum(tp) - sum(fp)) / (sum(tp) + sum(fn)), 9) AS gain FROM r""")
def eval_confusion(spark, sf):
    c = evaluate.evaluate(*three_versions(spark, sf))
    return c.withColumn("gain", F.round("gain", 9))


@query("s25_worst_reads", f"WITH {MUT} SELECT item_id, fp FROM r WHERE fp > 0")
def worst_reads(spark, sf):
    return per_read(spark, sf).filter("fp > 0").select("item_id", "fp")


@query("p13_indel_guard", "SELECT count(*) FILTER (WHERE abs(length(a.text) - length(b.text)) <= 3) AS kept, count(*) AS pairs FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def indel_guard(spark, sf):
    c = table(spark, sf, "conversations")
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("perfect"))
    t = c.select("conv_id", "turn", F.translate("text", "-", "~").alias("wrong")).join(y, ["conv_id", "turn"]).withColumn("corrected", F.col("perfect")).withColumn("perfect", F.translate("perfect", "-", "~"))
    return evaluate.comparable(t).agg(F.count(F.lit(1)).alias("kept")).join(t.agg(F.count(F.lit(1)).alias("pairs")), F.lit(True))


@query("a14_insert_size", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM events GROUP BY 1) SELECT e.event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM events e JOIN q ON e.event_type = q.event_type WHERE value >= lo AND value <= hi GROUP BY 1")
def insert_size(spark, sf):
    t = evaluate.trimmed_insert_size(table(spark, sf, "events"), "value", ["event_type"])
    return t.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("a17_unmapped", "SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS unmapped, count(*) AS reads FROM orders")
def unmapped(spark, sf):
    return evaluate.unmapped_count(table(spark, sf, "orders").select((F.col("o_orderstatus") != "P").alias("mapped")))


PAIRS = "p AS (SELECT l_partkey AS pos1, l_partkey + (l_suppkey * 7 + l_linenumber * 131) % 1000 AS pos2, l_returnflag = 'R' AS label FROM lineitem)"


@query("a18_pair_evaluation", f"WITH {PAIRS}, c AS (SELECT count(*) FILTER (WHERE pos2 - pos1 > 500 AND label) AS tp, count(*) FILTER (WHERE pos2 - pos1 > 500 AND NOT label) AS fp, count(*) FILTER (WHERE pos2 - pos1 <= 500 AND NOT label) AS tn, count(*) FILTER (WHERE pos2 - pos1 <= 500 AND label) AS fn FROM p) SELECT *, round(100.0::DOUBLE * (tp - fp) / (tp + fn), 9) AS gain, round(tp / (tp + fn), 9) AS sensitivity, round(1 - tn / (tn + fp), 9) AS fpr FROM c")
def pair_evaluation(spark, sf):
    l = table(spark, sf, "lineitem")
    p = l.select(F.col("l_partkey").alias("pos1"), (F.col("l_partkey") + (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 131) % 1000).alias("pos2"), (F.col("l_returnflag") == "R").alias("label"))
    r = evaluate.pair_evaluation(p)
    return r.select("tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("gain", "sensitivity", "fpr")])


@query("a19_rates", "WITH c AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, round(100.0::DOUBLE * f / n, 9) AS percent, round(f / (f + o), 9) AS sensitivity, round(o / (o + f), 9) AS specificity FROM c")
def rates(spark, sf):
    from ..functions import stats

    c = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count(F.lit(1)).alias("n"))
    f, o = F.col("f"), F.col("o")
    return c.select("o_orderpriority", F.round(stats.percentage(f, F.col("n")), 9).alias("percent"), F.round(stats.sensitivity(f, o), 9).alias("sensitivity"), F.round(stats.specificity(o, f), 9).alias("specificity"))


@query("a11_coverage", f"WITH {Q.seqs('documents', 'doc_id')} SELECT floor(count(*)::DOUBLE / sum(greatest(length(seq) - 20, 0)) * avg(length(seq)) * 1000)::BIGINT AS milli_coverage, floor(avg(length(seq)))::BIGINT AS mean_len FROM s")
def coverage(spark, sf):
    n = F.length("seq")
    r = sequences(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(n - 20, F.lit(0))).alias("size"), F.avg(n).alias("mean"))
    return r.select(F.floor(F.col("n").cast("double") / F.col("size") * F.col("mean") * 1000).alias("milli_coverage"), F.floor("mean").alias("mean_len"))


SAMQ = """f AS (SELECT item_id, seq FROM s WHERE length(seq) >= 60),
x AS (SELECT item_id, seq, (item_id % 7 + 1)::INTEGER AS pos, item_id % 2 = 1 AS turned FROM f),
o AS (SELECT item_id, turned, 'NNNNN' || substr(seq, pos, 20) || 'NN' || substr(seq, pos + 20 + 3, length(seq) - 40) AS out FROM x)"""


@query("c02_cigar_project", f"WITH {Q.seqs('benchmark', 'item_id')}, {SAMQ} SELECT item_id AS rec_id, TRUE AS mapped, CASE WHEN turned THEN {Q.rc('out')} ELSE out END AS read FROM o")
def cigar_project(spark, sf):
    """Reads along 5S20M2I3D and the rest M on the benchmark's whole sequences, odd ones reversed."""
    s = sequences(spark, sf, "benchmark", "item_id").filter(F.length("seq") >= 60)
    name = F.concat(F.lit("q"), "item_id")
    reads = s.select(F.col("item_id").alias("rec_id"), F.concat(F.lit("@"), name, F.lit("\n")).alias("pre"), F.substring(F.col("seq"), F.lit(1), F.length("seq") - 13).alias("read"))
    sam = s.select(name.alias("qname"), F.when(F.col("item_id") % 2 == 1, 16).otherwise(0).alias("flag"), name.alias("rname"), (F.col("item_id") % 7 + 1).cast("int").alias("pos"), F.concat(F.lit("5S20M2I3D"), F.length("seq") - 40, F.lit("M")).alias("cigar"), F.lit(0).alias("nm"), F.lit("").alias("xa"))
    return evaluate.sam_to_reads(reads, sam, s.select(name.alias("rname"), "seq"))


@query("p16_name_check", "SELECT count(*) FILTER (WHERE item_id % 3 = 0) AS different FROM benchmark")
def name_check(spark, sf):
    b = table(spark, sf, "benchmark")
    reads = b.select(F.col("item_id").alias("rec_id"), F.concat(F.lit("@r"), "item_id", F.lit("/1")).alias("pre"))
    sam = b.select(F.col("item_id").alias("rec_id"), F.concat(F.lit("r"), F.col("item_id") + F.when(F.col("item_id") % 3 == 0, 1).otherwise(0)).alias("qname"))
    return evaluate.consistent_names(reads, sam).agg(F.count(F.lit(1)).alias("different"))
