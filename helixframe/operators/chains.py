"""Counted node paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import numbered
from .markov import reverse_chain


def representative(chain: Column) -> Column:
    """The smaller of a chain and its reverse complement, element by element."""
    return F.least(chain, reverse_chain(chain))


def distinct_chains(chains: DataFrame, least_nodes: int = 2) -> DataFrame:
    """``chain, n`` with both strands added up; ``n`` of the input counts if there."""
    weight = F.col("n") if "n" in chains.columns else F.lit(1).cast("long")
    used = chains.filter(F.size("chain") >= least_nodes)
    return used.groupBy(representative(F.col("chain")).alias("chain")).agg(F.sum(weight).alias("n"))


def chain_index(chains: DataFrame, key: str = "chain_id") -> DataFrame:
    return chains.select(key, F.posexplode("chain").alias("pos", "node"))


def occurrences(chains: DataFrame, pattern: list[int], key: str = "chain_id") -> DataFrame:
    """``key, pos, turned``: where a pattern or its reverse complement lies."""
    turned = [-x for x in reversed(pattern)]
    found = []
    for p, way in ((pattern, False), (turned, True)):
        if way and turned == pattern:
            continue
        want = F.array(*[F.lit(x) for x in p])
        starts = chain_index(chains, key).filter(F.col("node") == p[0])
        hit = starts.join(chains.select(key, "chain"), key).filter(F.slice("chain", F.col("pos") + 1, len(p)) == want)
        found.append(hit.select(key, "pos", F.lit(way).alias("turned")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def invalid_chains(chains: DataFrame, arcs: DataFrame, key: str = "chain_id") -> DataFrame:
    """Keys of chains with a step that is no arc."""
    c = F.col("chain")
    steps = chains.filter(F.size(c) > 1).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("src"), F.element_at(c, i + 1).alias("dst")))).alias("x")).select(key, "x.*")
    return steps.join(arcs.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(key).distinct()


def paired_links(pairs: DataFrame) -> DataFrame:
    """``idx1, turned1, idx2, turned2, n``: how often two chains are joined by mates (A16); the sign is its own column."""
    return pairs.groupBy("idx1", "turned1", "idx2", "turned2").agg(F.count(F.lit(1)).alias("n"))


def mates(first: DataFrame, second: DataFrame, key: str = "rec_id") -> DataFrame:
    """Mate 1 and mate 2 by record."""
    return first.select(key, F.col("chain").alias("chain1")).join(second.select(key, F.col("chain").alias("chain2")), key)


def between(chains: DataFrame, left: int, right: int) -> DataFrame:
    """``path, n``: the sub-paths from ``left`` to the next ``right``, both strands, counted."""
    c = F.col("chain")
    both = chains.select(c.alias("chain"), *(["n"] if "n" in chains.columns else [])).unionByName(chains.select(reverse_chain(c).alias("chain"), *(["n"] if "n" in chains.columns else [])))
    starts = both.select("*", F.posexplode("chain").alias("p", "node")).filter(F.col("node") == left)
    rest = starts.withColumn("rest", F.slice("chain", F.col("p") + 1, F.size("chain"))).withColumn("end", F.array_position("rest", right)).filter("end > 0")
    weight = F.sum("n") if "n" in chains.columns else F.count(F.lit(1))
    return rest.groupBy(F.slice("rest", F.lit(1), F.col("end").cast("int")).alias("path")).agg(weight.alias("n"))


def consensus(paths: DataFrame) -> DataFrame:
    """``pos, nodes, best``: how many nodes the paths show at each place, and the commonest."""
    votes = paths.select(F.posexplode("path").alias("pos", "node"), "n").groupBy("pos", "node").agg(F.sum("n").alias("n"))
    return votes.groupBy("pos").agg(F.count(F.lit(1)).alias("nodes"), F.max_by("node", F.struct("n", -F.col("node"))).alias("best"))


def is_non_branching(paths: DataFrame) -> DataFrame:
    return consensus(paths).agg((F.max("nodes") == 1).alias("non_branching"))


def smoothed(chains: DataFrame, node: int) -> DataFrame:
    """Chains whose successor of ``node`` isn't the commonest one get that one instead (majority vote, G15)."""
    c = F.col("chain")
    after = chains.select(F.posexplode("chain").alias("p", "x"), "chain").filter(F.col("x") == node).select(F.get("chain", F.col("p") + 1).alias("next")).filter("next is not null")
    best = after.groupBy("next").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "next").limit(1).collect()
    if not best:
        return chains
    want = F.lit(best[0]["next"])
    return chains.withColumn("chain", F.transform(c, lambda x, i: F.when((i > 0) & (F.get(c, i - 1) == node), want).otherwise(x)))


def reduced(chains: DataFrame, path: list[int], by: list[int]) -> DataFrame:
    """Every occurrence of ``path`` (and of its reverse) replaced (G15): on text keys, so no index has to be kept."""
    text = lambda xs: " " + " ".join(map(str, xs)) + " "
    back = lambda xs: [-x for x in reversed(xs)]
    joined = F.concat(F.lit(" "), F.array_join(F.col("chain").cast("array<string>"), " "), F.lit(" "))
    for old, new in ((path, by), (back(path), back(by))):
        joined = F.replace(joined, F.lit(text(old)), F.lit(text(new)))
    return chains.withColumn("chain", F.transform(F.split(F.trim(joined), " +"), lambda x: x.cast("int")))


def pair_report(links: DataFrame, chains: DataFrame, key: str = "chain_id") -> DataFrame:
    """Chain pairs with their paths, most linked first."""
    a = chains.select(F.col(key).alias("idx1"), F.col("chain").alias("chain1"))
    b = chains.select(F.col(key).alias("idx2"), F.col("chain").alias("chain2"))
    return links.join(a, "idx1").join(b, "idx2").orderBy(F.desc("n"), "idx1", "idx2")


def numbered_report(links: DataFrame, chains: DataFrame, key: str = "chain_id") -> DataFrame:
    """:func:`pair_report` with ``place``, numbered without one task seeing all pairs."""
    ordered = pair_report(links, chains, key).withColumn("less__", -F.col("n"))
    return numbered(ordered, ["less__", "idx1", "idx2"], "place").drop("less__")
