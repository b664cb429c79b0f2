"""Variable-order Markov tables over node paths."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import expected_coverage, log10_poisson_ratio
from ..session import materialise
from .seeds import islands, kmer_index, lookup

ORDERS = range(2, 10)
LEAST_EXPECTED = 10
LEAST_ODDS = 5


def reverse_chain(chain: Column) -> Column:
    return F.transform(F.reverse(chain), lambda x: -x)


def chain_grams(chains: DataFrame, orders=ORDERS, both_strands: bool = True) -> DataFrame:
    """``ord, chain, next_node``: every sub-path of order + 1 nodes, split before its last; chains of two nodes or fewer give none."""
    c = F.col("chain")
    used = chains.filter(F.size(c) >= 3).select("chain")
    if both_strands:
        used = used.unionByName(used.select(reverse_chain(c).alias("chain")))
    parts = []
    for order in orders:
        starts = F.sequence(F.lit(1), F.size(c) - order)
        cut = F.when(F.size(c) > order, F.transform(starts, lambda i: F.struct(F.slice(c, i, order).alias("chain"), F.get(c, i + order - 1).alias("next_node"))))
        parts.append(used.select(F.lit(order).alias("ord"), F.explode(cut).alias("x")).select("ord", "x.chain", "x.next_node"))
    return reduce(DataFrame.unionByName, parts)


def chain_length(chain: Column, lengths: Column, k: int) -> Column:
    """k + 1 plus the marginal lengths of inner nodes; 0 for two nodes or fewer."""
    inner = F.slice(lengths, 2, F.greatest(F.size(lengths) - 2, F.lit(0)))
    return F.when(F.size(chain) <= 2, 0).otherwise(F.aggregate(inner, F.lit(0), lambda a, x: a + x.cast("int")) + k + 1)


def transitions(chains: DataFrame, orders=ORDERS, both_strands: bool = True, branching: DataFrame | None = None) -> DataFrame:
    """``ord, chain, next_node, freq`` (A10); with ``branching`` (column node), only from nodes with several right arcs."""
    grams = chain_grams(chains, orders, both_strands)
    if branching is not None:
        grams = grams.join(branching.select(F.col("node").alias("last__")), F.element_at("chain", -1) == F.col("last__"), "left_semi")
    return grams.groupBy("ord", "chain", "next_node").agg(F.count(F.lit(1)).alias("freq"))


def with_lengths(table: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Transitions with the mean length of their paths (all paths of equal nodes have one length)."""
    rows = table.withColumn("row__", F.xxhash64("chain", "next_node", "ord"))
    inner = rows.select("row__", "ord", "chain", "next_node", F.explode(F.slice("chain", F.lit(2), F.size("chain"))).alias("n")).withColumn("node_id", F.abs("n").cast("int")).join(nodes.select("node_id", "marg_len"), "node_id", "left")
    sums = inner.groupBy("ord", "chain", "next_node").agg((F.sum("marg_len") + k + 1).cast("double").alias("avg_len"))
    return table.join(sums, ["ord", "chain", "next_node"], "left")


def merged(tables: list[DataFrame]) -> DataFrame:
    """Tables trained apart, added up."""
    return reduce(DataFrame.unionByName, tables).groupBy("ord", "chain", "next_node").agg(F.sum("freq").alias("freq"))


def conditional(table: DataFrame) -> DataFrame:
    """Transitions with their context's total and conditional probability."""
    totals = table.groupBy("ord", "chain").agg(F.sum("freq").alias("total"))
    return table.join(totals, ["ord", "chain"]).withColumn("probability", F.col("freq") / F.col("total"))


def decide(table: DataFrame, coverage: float, mean_length: float, from_seeds: bool = False, floor: bool = True) -> DataFrame:
    """``expected, odds, accepted`` of each transition.

    A transition is rejected if its count is below the expected coverage of paths of its length and
    log10 of Poisson(1) against Poisson(expected) is above the least odds.  Contexts expected less
    than ten times accept all.  Coverage and mean length are cut to whole numbers as by default.
    """
    cover, mean = (math.floor(coverage), math.floor(mean_length)) if floor else (coverage, mean_length)
    expected = expected_coverage(F.lit(float(cover)), F.lit(float(max(mean, 1))), F.col("avg_len"), from_seeds)
    out = table.withColumn("expected", expected)
    odds = F.when(F.col("expected") > 0, log10_poisson_ratio(F.col("freq").cast("double"), F.lit(1.0), F.col("expected")))
    reject = (F.col("expected") >= LEAST_EXPECTED) & (F.col("odds") > LEAST_ODDS) & (F.col("freq") < F.col("expected"))
    return out.withColumn("odds", odds).withColumn("accepted", ~F.coalesce(reject, F.lit(False)))


def estimated_coverage(num_reads: int, graph_size: int, mean_length: float) -> float:
    """Reads over graph size times mean length."""
    return num_reads / graph_size * mean_length if graph_size else 0.0


def ending_in(table: DataFrame, shorter: DataFrame, order: int, how: str) -> DataFrame:
    """Rows of higher order whose chain ends in one of ``shorter``'s chains of ``order`` nodes: a suffix semi or anti join as an equi-join."""
    keys = shorter.filter(F.col("ord") == order).select(F.col("chain").alias("suffix__")).distinct()
    return table.join(keys, F.slice("chain", -order, order) == F.col("suffix__"), how)


def propagate(table: DataFrame, orders=ORDERS, mark: bool = False) -> DataFrame:
    """Lowest order first: where one next node survives, longer chains ending there are dropped.

    With ``mark``, where several survive, longer chains' transitions that a shorter one rejects are
    rejected too (off by default: the effective behaviour to match is that nothing happens).
    """
    for order in orders:
        alive = table.filter((F.col("ord") == order) & F.col("accepted"))
        single = alive.groupBy("ord", "chain").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
        low, high = table.filter(F.col("ord") <= order), table.filter(F.col("ord") > order)
        high = ending_in(high, single, order, "left_anti")
        if mark:
            no = table.filter((F.col("ord") == order) & ~F.col("accepted")).select(F.col("chain").alias("suffix__"), F.col("next_node").alias("no__"), F.lit(False).alias("keep__")).distinct()
            high = high.join(no, (F.slice("chain", -order, order) == F.col("suffix__")) & (F.col("next_node") == F.col("no__")), "left").withColumn("accepted", F.col("accepted") & F.coalesce("keep__", F.lit(True))).select(*table.columns)
        table = materialise(low.unionByName(high), "markov")
    return table


def train(chains: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, coverage: float, mean_length: float, orders=ORDERS, from_seeds: bool = False) -> DataFrame:
    """The Markov table of a set of node paths (M01, M08); ``from_seeds``: errors thin the expected coverage."""
    branching = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")
    return propagate(decide(with_lengths(transitions(chains, orders, True, branching), nodes, k), coverage, mean_length, from_seeds), orders)


def seed_chains(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, key: str = "rec_id", least: int = ORDERS[0] + 1) -> DataFrame:
    """``key, chain``: the node paths of each read's k-mers, where they are of ``least`` nodes or more.

    A path goes on over k-mers that the graph doesn't have if what follows them lies where it would lie
    without the error.  Reads of less than k + 2 bases give none.
    """
    used = reads.select(key, "seq").filter(F.length("seq") >= k + ORDERS[0])
    hits = lookup(used, kmer_index(nodes, k), k, key)
    return islands(hits, arcs, key).filter(F.size("chain") >= least).select(key, "chain")


def train_from_seeds(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, orders=ORDERS, key: str = "rec_id") -> DataFrame:
    """The Markov table of reads as they are, without an alignment.

    Coverage and mean length are those of all reads, short ones too; no reads give an empty table.
    """
    seen = reads.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("seq")).alias("mean")).first()
    size = nodes.agg(F.sum("marg_len").alias("size")).first()["size"] or 0
    mean = seen["mean"] or 0.0
    chains = materialise(seed_chains(reads, nodes, arcs, k, key), "seed_chains")
    return train(chains, nodes, arcs, k, estimated_coverage(seen["n"], size, mean), mean, orders, True)


def longest_context(paths: DataFrame, table: DataFrame, keys: list[str], orders=ORDERS) -> DataFrame:
    """``keys, ord, chain``: the longest suffix of each path that the table knows."""
    c = F.col("chain")
    asked = paths.select(*keys, F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.slice(c, -o, o).alias("chain")) for o in orders if o > 0])).alias("x"), F.size(c).alias("n")).filter(F.col("x.ord") <= F.col("n")).select(*keys, "x.ord", "x.chain")
    known = asked.join(table.select("ord", "chain").distinct(), ["ord", "chain"])
    return known.groupBy(*keys).agg(F.max("ord").alias("ord"), F.max_by("chain", "ord").alias("chain"))


def eligible_next(paths: DataFrame, table: DataFrame, arcs: DataFrame, keys: list[str], orders=ORDERS) -> DataFrame:
    """``keys, next_node``: where each path may go on.

    A known context allows its accepted next nodes, an unknown one (or a last node with one arc)
    every arc; what is allowed must be an arc.
    """
    context = longest_context(paths, table, keys, orders)
    ends = paths.select(*keys, F.element_at("chain", -1).alias("last"))
    outgoing = ends.join(arcs.select(F.col("src").alias("last"), F.col("dst").alias("next_node")).distinct(), "last")
    accepted = context.join(table.filter("accepted").select("ord", "chain", "next_node"), ["ord", "chain"]).select(*keys, "next_node", F.lit(True).alias("ok"))
    single = outgoing.groupBy(*keys).agg(F.count(F.lit(1)).alias("arcs_out"))
    judged = outgoing.join(single, keys).join(context.select(*keys, F.lit(True).alias("known")), keys, "left").join(accepted, [*keys, "next_node"], "left")
    return judged.filter("known is null or ok or arcs_out = 1").select(*keys, "next_node")


def contradicted(chains: DataFrame, table: DataFrame, keys: list[str], orders=ORDERS) -> DataFrame:
    """Steps of true chains that the table rejects."""
    c = F.col("chain")
    parts = [chains.filter(F.size(c) > o).select(*keys, F.lit(o).alias("ord"), F.explode(F.transform(F.sequence(F.lit(1), F.size(c) - o), lambda i: F.struct(F.slice(c, i, o).alias("chain"), F.get(c, i + o - 1).alias("next_node")))).alias("x")).select(*keys, "ord", "x.chain", "x.next_node") for o in orders]
    return reduce(DataFrame.unionByName, parts).join(table.filter(~F.col("accepted")), ["ord", "chain", "next_node"], "left_semi")
