"""The bidirected graph: links, unitigs, arcs, and graph algorithms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import seq as S
from ..session import discard, materialise, numbered


def signed_kmers(overlaps: DataFrame) -> DataFrame:
    """``kmer, bf, n`` for both strands of every canonical k-mer."""
    other = overlaps.select(S.revcomp(F.col("canon")).alias("kmer"), S.revcomp_mask(F.col("bf")).alias("bf"), "n")
    return overlaps.select(F.col("canon").alias("kmer"), "bf", "n").unionByName(other)


def unique_links(overlaps: DataFrame) -> DataFrame:
    """``kmer, next``: the right neighbour where both sides have one only; hairpins and own loops aren't links."""
    both = signed_kmers(overlaps)
    right = F.col("bf").bitwiseAND(F.lit(15))
    base = F.when(right == 8, "A").when(right == 4, "C").when(right == 2, "G").when(right == 1, "T")
    out = both.select("kmer", base.alias("base")).filter("base is not null").select("kmer", S.push_right(F.col("kmer"), F.col("base")).alias("next"))
    single = both.filter(S.left_degree(F.col("bf")) == 1).select(F.col("kmer").alias("next"))
    return out.filter((F.col("next") != F.col("kmer")) & (F.col("next") != S.revcomp(F.col("kmer")))).join(single, "next", "left_semi").select("kmer", "next")


def branching_kmers(overlaps: DataFrame) -> DataFrame:
    degrees = overlaps.select("canon", S.left_degree(F.col("bf")).cast("int").alias("left_degree"), S.right_degree(F.col("bf")).cast("int").alias("right_degree"))
    return degrees.filter("left_degree > 1 or right_degree > 1")


def list_ranks(links: DataFrame, keys: DataFrame) -> DataFrame:
    """``kmer, tail, steps``: the end of each chain by pointer doubling, in a logarithmic number of self-joins.

    A cycle has no end: it is broken before its smallest canonical k-mer, and its other strand at the
    same place, so that both strands spell one node.
    """
    base = keys.join(links, "kmer", "left")
    n = max(2, base.count())
    rounds = math.ceil(math.log2(n)) + 1
    now = materialise(base.select("kmer", F.coalesce("next", "kmer").alias("tail"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("next").isNull().alias("done"), F.least(S.canonical(F.col("kmer")), S.canonical(F.coalesce("next", "kmer"))).alias("low")), "ranks")
    for _ in range(rounds):
        ahead = now.select(F.col("kmer").alias("k2"), F.col("tail").alias("t2"), F.col("steps").alias("s2"), F.col("done").alias("d2"), F.col("low").alias("l2"))
        now = materialise(now.join(ahead, now["tail"] == ahead["k2"]).select("kmer", F.col("t2").alias("tail"), F.when(F.col("done"), F.col("steps")).otherwise(F.col("steps") + F.col("s2")).alias("steps"), (F.col("done") | F.col("d2")).alias("done"), F.least("low", "l2").alias("low")), "ranks")
        if now.filter("not done").isEmpty():
            return now.select("kmer", "tail", "steps")
    cyclic = now.filter("not done").select("kmer", "low")
    cut = links.join(cyclic, "kmer").filter((F.col("next") != F.col("low")) & (F.col("kmer") != S.revcomp(F.col("low")))).select("kmer", "next")
    return now.filter("done").select("kmer", "tail", "steps").unionByName(list_ranks(cut, cyclic.select("kmer")))


def unitigs(overlaps: DataFrame, k: int) -> DataFrame:
    """``node_id, seq, len, marg_len, kmer_cov, read_start_cov``: maximal non-branching paths, one orientation each."""
    overlaps = materialise(overlaps, "overlaps")
    both = materialise(signed_kmers(overlaps).select("kmer", "n"), "signed")
    ranks = list_ranks(materialise(unique_links(overlaps), "links"), both.select("kmer"))
    chains = ranks.join(both, "kmer").groupBy("tail").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), "kmer"))).alias("path"), F.sum("n").alias("kmer_cov"))
    spelled = chains.select(F.concat(F.col("path")[0]["kmer"], F.array_join(F.transform(F.slice(F.col("path"), 2, 1 << 30), lambda x: F.substring(x["kmer"], -1, 1)), "")).alias("seq"), "kmer_cov")
    kept = spelled.withColumn("own", F.least("seq", S.revcomp(F.col("seq")))).groupBy("own").agg(F.max("kmer_cov").alias("kmer_cov"))
    rows = numbered(kept.withColumnRenamed("own", "seq"), ["seq"], "node_id")
    return rows.select(F.col("node_id").cast("int").alias("node_id"), "seq", F.length("seq").alias("len"), S.marginal_length(F.col("seq"), k).alias("marg_len"), "kmer_cov", F.lit(0).cast("long").alias("read_start_cov"))


def signed_nodes(nodes: DataFrame) -> DataFrame:
    """``node, seq`` for both strands; a negative id is the reverse complement."""
    return nodes.select(F.col("node_id").alias("node"), "seq").unionByName(nodes.select((-F.col("node_id")).alias("node"), S.revcomp(F.col("seq")).alias("seq")))


def arcs_of(nodes: DataFrame, overlaps: DataFrame, k: int) -> DataFrame:
    """``src, dst, base, cov``: right arcs of both strands, from the last k-mer's bits to the node that starts there."""
    ends = signed_nodes(nodes).select("node", F.substring("seq", 1, k).alias("first"), F.expr(f"right(seq, {k})").alias("last"))
    masks = signed_kmers(overlaps).select(F.col("kmer").alias("last"), "bf")
    step = ends.join(masks, "last").select(F.col("node").alias("src"), "last", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), S.has(F.col("bf"), S.right_bit(F.lit(b))).alias("there")) for b in S.BASES])).alias("x")).filter("x.there")
    targets = ends.select(F.col("node").alias("dst"), F.col("first").alias("next"))
    n = overlaps.select(F.col("canon").alias("next_canon"), "n")
    found = step.select("src", F.col("x.base").alias("base"), S.push_right(F.col("last"), F.col("x.base")).alias("next")).join(targets, "next")
    return found.withColumn("next_canon", S.canonical(F.col("next"))).join(n, "next_canon").select("src", "dst", "base", F.col("n").alias("cov"))


def rebuilt_arcs(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """``arcs`` with ``found``: the node that begins where an arc's source and base lead (S13); null if none does."""
    ends = signed_nodes(nodes).select("node", F.substring("seq", 1, k).alias("first"), F.expr(f"right(seq, {k - 1})").alias("last"))
    asked = arcs.join(ends.select(F.col("node").alias("src"), "last"), "src", "left").withColumn("next__", F.concat("last", "base"))
    return asked.join(ends.select(F.col("node").alias("found"), F.col("first").alias("next__")), "next__", "left").select(*arcs.columns, "found")


def degrees(arcs: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree`` over signed ids."""
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "node", "full").select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def unique_neighbours(arcs: DataFrame) -> DataFrame:
    """Arcs whose source has no other right arc and whose target has no other left arc."""
    d = degrees(arcs)
    return arcs.join(d.filter("out_degree = 1").select(F.col("node").alias("src")), "src", "left_semi").join(d.filter("in_degree = 1").select(F.col("node").alias("dst")), "dst", "left_semi")


def graph_stats(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row: nodes, arcs, N50, total and largest marginal length."""
    n_arcs = arcs.agg(F.count(F.lit(1)).alias("arcs"))
    total = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.sum("marg_len").alias("graph_size"), F.sum("len").alias("total_len"))
    return total.join(n50(nodes.select("len")), F.lit(True)).join(n_arcs, F.lit(True)).select("nodes", "arcs", "n50", "graph_size", "total_len")


def n50(lengths: DataFrame, column: str = "len") -> DataFrame:
    """The length from which longer ones hold half of all bases.

    Lengths are aggregated first, so the ordered window sees one row per distinct length.
    """
    by = lengths.groupBy(F.col(column).alias("l")).agg(F.sum(F.col(column).cast("long")).alias("bases"))
    running = by.select("l", F.sum("bases").over(Window.orderBy("l").rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.sum("bases").over(Window.partitionBy(F.lit(1))).alias("total"))
    return running.filter("2 * sum >= total").agg(F.min("l").cast("long").alias("n50"))


def asymmetric_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs a -> b without their counterpart -b -> -a."""
    return arcs.join(arcs.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")), ["src", "dst"], "left_anti")


def overlap_breaks(nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """Arcs whose nodes don't overlap by k - 1 bases."""
    both = signed_nodes(nodes)
    a = both.select(F.col("node").alias("src"), F.expr(f"right(seq, {k - 1})").alias("tail"))
    b = both.select(F.col("node").alias("dst"), F.substring("seq", 1, k - 1).alias("head"))
    return arcs.select("src", "dst").distinct().join(a, "src").join(b, "dst").filter("tail <> head").select("src", "dst")


def spell(paths: DataFrame, nodes: DataFrame, k: int, keys: list[str], chain: str = "chain") -> DataFrame:
    """``keys, seq``: the sequence of each path."""
    steps = paths.select(*keys, F.posexplode(chain).alias("at", "node")).join(signed_nodes(nodes), "node")
    part = F.when(F.col("at") == 0, F.col("seq")).otherwise(F.substring(F.col("seq"), k, 1 << 30))
    return steps.select(*keys, "at", part.alias("part")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("x")).select(*keys, F.array_join(F.transform("x", lambda p: p["part"]), "").alias("seq"))


def path_coverage(paths: DataFrame, nodes: DataFrame, keys: list[str], chain: str = "chain") -> DataFrame:
    """Length-weighted mean k-mer coverage of each path."""
    steps = paths.select(*keys, F.explode(chain).alias("node")).withColumn("node_id", F.abs("node").cast("int")).join(nodes.select("node_id", "kmer_cov", "marg_len"), "node_id")
    return steps.groupBy(*keys).agg((F.sum("kmer_cov") / F.sum("marg_len")).alias("mean_cov"))


def neighbourhood(arcs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: what seeds (column ``node``) reach in up to ``depth`` arcs in either direction."""
    steps = arcs.select("src", "dst").unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = materialise(seeds.select("node", F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        new = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialise(new.select("node", F.lit(d).alias("depth")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: A search by length goes on in leaps of more than this part of its bound.
LEAPS = 8
#: Arcs that are sent to every task, 12 bytes each and 16 a node; sources that a task searches from, at most about.
BROADCAST_STEPS, SOURCES = 4_000_000, 1024


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.min("dist").alias("dist"))


def _joined(first: DataFrame, then: DataFrame, max_len: int) -> DataFrame:
    """``src, dst, dist``: paths ``first`` that go on with ``then``, no longer than ``max_len``."""
    on = then.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("dist").alias("more"))
    return first.join(on, "dst").select("src", F.col("end").alias("dst"), (F.col("dist") + F.col("more")).alias("dist")).filter(F.col("dist") <= max_len)


def _near(priced: DataFrame, max_len: int) -> DataFrame:
    """``src, dst, dist`` up to ``max_len``: paths are joined with paths until none is new or shorter; every round doubles their arcs."""
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum("dist")).first())
    near = materialise(priced.filter(F.col("dist") <= max_len), "near")
    now, old = state(near), None
    while now != old:
        new = materialise(_least(near.unionByName(_joined(near, near, max_len))), "near")
        discard(near)
        near, now, old = new, state(new), now
    return near


def _priced(arcs: DataFrame, lengths: DataFrame, max_len: int, backward: bool) -> DataFrame:
    """``src, dst, dist``: each arc once with the length of the node it enters."""
    steps = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else arcs.select("src", "dst")
    cost = F.col("marg_len").cast("long").alias("dist")
    return materialise(_least(steps.distinct().join(lengths.withColumnRenamed("node", "dst"), "dst").select("src", "dst", cost).filter(F.col("dist") <= max_len)), "priced")


def _searched(asked: DataFrame, priced: DataFrame, max_len: int) -> DataFrame:
    """``source, node, dist`` by searches in tasks that hold all arcs; of ``asked`` columns ``source`` and, where only these pairs are wanted, ``node``."""
    spark = priced.sparkSession
    steps = paths.Steps(*(np.asarray(c, np.int64) for c in priced.select("src", "dst", "dist").toArrow().columns))
    held = spark.sparkContext.broadcast(steps)
    some = "node" in asked.columns

    def run(source):
        steps = held.value
        number = lambda ids: np.searchsorted(steps.ids, ids)
        for b in source:
            ids = [np.asarray(c, np.int64) for c in b.columns]
            known = np.logical_and.reduce([np.isin(c, steps.ids) for c in ids])
            wanted = [number(c[known]) for c in ids]
            for block, near, length in paths.shortest(steps, np.unique(wanted[0]), max_len):
                if some:
                    own = np.isin(wanted[0], block) & np.isin(wanted[1], near)
                    row, node = np.searchsorted(block, wanted[0][own]), np.searchsorted(near, wanted[1][own])
                    there = length[row, node] >= 0
                    row, node = row[there], node[there]
                else:
                    row, node = np.nonzero(length >= 0)
                for low in range(0, len(row), paths.ROWS):
                    r, n = row[low : low + paths.ROWS], node[low : low + paths.ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(steps.ids[block[r]]), pa.array(steps.ids[near[n]]), pa.array(length[r, n])], names=["source", "node", "dist"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(steps.ids) // SOURCES))
    dealt = asked.select(*(F.col(c).cast("long") for c in asked.columns)).dropna().repartition(parts, "source").distinct()
    found = (dealt.sortWithinPartitions("source") if some else dealt).mapInArrow(run, "source long, node long, dist long")
    return found.select(F.col("source").cast(asked.schema["source"].dataType), F.col("node").cast(priced.schema["dst"].dataType), "dist")


def reachable(arcs: DataFrame, lengths: DataFrame, sources: DataFrame, max_len: int, backward: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """``source, node, dist``: shortest lengths up to ``max_len`` along arcs (G06, and backward G08).

    ``lengths`` has ``node, marg_len``; a step costs the length of the node it enters, a base at least.
    A source reaches itself again only through a loop.  ``pairs`` (``source, node``): only these are returned.

    Up to ``BROADCAST_STEPS`` arcs (counted first) are sent to every task once, which searches from blocks of sources.
    A larger graph is joined: paths of up to an eighth of ``max_len`` are found
    from every node by doubling.  Such a path and an arc more that makes it longer are a leap, so that a
    frontier join of leaps ends after eight rounds, whatever the nodes' lengths; the rest of a path is short again.
    """
    priced = _priced(arcs, lengths, max_len, backward)
    if priced.count() <= BROADCAST_STEPS:
        asked = sources.select(F.col("node").alias("source")).distinct()
        return _searched(asked if pairs is None else pairs.select("source", "node").join(asked, "source", "left_semi"), priced, max_len)
    reach = -(-max_len // LEAPS)
    near = _near(priced, reach)
    leaps = materialise(_least(priced.unionByName(_joined(near, priced, max_len)).filter(F.col("dist") > reach)), "leaps")
    starts = sources.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist")).distinct()
    front = best = materialise(_least(_joined(starts, leaps, max_len)), "front")
    while not front.isEmpty():
        reached = _least(_joined(front, leaps, max_len))
        better = reached.join(best.withColumnRenamed("dist", "old"), ["src", "dst"], "left").filter("old is null or dist < old").drop("old")
        step = materialise(better, "front")
        new = materialise(best.join(step.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(step), "best")
        discard(best, front)
        front, best = step, new
    ended = best.unionByName(_joined(starts.unionByName(best), near, max_len))
    found = _least(ended).select(F.col("src").alias("source"), F.col("dst").alias("node"), "dist")
    return found if pairs is None else found.join(pairs, ["source", "node"], "left_semi")


def find_paths(arcs: DataFrame, lengths: DataFrame, pairs: DataFrame, max_len: int) -> DataFrame:
    """``pair`` columns with ``dist`` between two graph positions, null if none within ``max_len``.

    pairs: ``src, src_pos, dst, dst_pos``.  Within a node the distance is that of the positions.
    """
    wanted = pairs.select(F.col("src").alias("source"), F.col("dst").alias("node"))
    dist = reachable(arcs, lengths, wanted.select(F.col("source").alias("node")).distinct(), max_len * 2, pairs=wanted)
    own = lengths.select(F.col("node").alias("dst"), F.col("marg_len").alias("dst_len"))
    src_len = lengths.select(F.col("node").alias("src"), F.col("marg_len").alias("src_len"))
    joined = pairs.join(dist.select(F.col("source").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("d")), ["src", "dst"], "left").join(own, "dst").join(src_len, "src")
    inside = F.when((F.col("src") == F.col("dst")) & (F.col("dst_pos") >= F.col("src_pos")), F.col("dst_pos") - F.col("src_pos"))
    across = F.col("d") - F.col("dst_len") + (F.col("src_len") - F.col("src_pos")) + F.col("dst_pos")
    found = F.least(inside, across)
    return joined.select(*pairs.columns, F.when(found <= max_len, found).alias("dist"))


def parallel_paths(arcs: DataFrame) -> DataFrame:
    """``node, other``: nodes with the same left and right neighbours, two hops around each node."""
    mid = arcs.select(F.col("src").alias("left"), F.col("dst").alias("node")).join(arcs.select(F.col("src").alias("node"), F.col("dst").alias("right")), "node")
    other = mid.select("left", "right", F.col("node").alias("other"))
    return mid.join(other, ["left", "right"]).filter("node <> other").select("node", "other").distinct()


def rewire(arcs: DataFrame, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """Arcs without ``removed`` and with ``added``, each with its counterpart on the other strand."""
    mirror = lambda df: df.select("src", "dst").unionByName(df.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst"))).distinct()
    out = arcs if removed is None else arcs.join(mirror(removed), ["src", "dst"], "left_anti")
    if added is not None:
        out = out.unionByName(mirror(added).join(out, ["src", "dst"], "left_anti"), allowMissingColumns=True)
    return out


def drop_nodes(nodes: DataFrame, arcs: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without ``dead`` (column node_id) and the arcs that touch it."""
    both = dead.select(F.col("node_id").alias("node")).unionByName(dead.select((-F.col("node_id")).alias("node")))
    left = arcs.join(both.withColumnRenamed("node", "src"), "src", "left_anti").join(both.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return nodes.join(dead, "node_id", "left_anti"), left


def reductions(arcs: DataFrame) -> DataFrame:
    """``start, via, end``: nodes between unique neighbours, which one arc start -> end can stand for."""
    single = unique_neighbours(arcs).select("src", "dst")
    return single.select(F.col("src").alias("start"), F.col("dst").alias("via")).join(single.select(F.col("src").alias("via"), F.col("dst").alias("end")), "via").filter("start <> end and start <> via and via <> end").select("start", "via", "end")


def apply_reductions(arcs: DataFrame, found: DataFrame) -> DataFrame:
    gone = found.select(F.col("start").alias("src"), F.col("via").alias("dst")).unionByName(found.select(F.col("via").alias("src"), F.col("end").alias("dst")))
    return rewire(arcs, gone, found.select(F.col("start").alias("src"), F.col("end").alias("dst")))


def first_valid_node(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("node_id").alias("node_id"))


def arc_coverage(arcs: DataFrame, chains: DataFrame, chain: str = "chain") -> DataFrame:
    """Arcs with the number of times that chains walk them, on either strand."""
    c = F.col(chain)
    pairs = chains.filter(F.size(c) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("src"), F.element_at(c, i + 1).alias("dst")))).alias("x")).select("x.*")
    both = pairs.unionByName(pairs.select((-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")))
    walked = both.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("walked"))
    return arcs.join(walked, ["src", "dst"], "left").withColumn("walked", F.coalesce("walked", F.lit(0)))


def text_offsets(nodes: DataFrame, per_slot: int = 2, gap: int = 2) -> DataFrame:
    """``node_id, start``: where each node's slot (both strands and separators) begins in a concatenated text.

    Prefix sums go through per-range totals, so no task sees all nodes.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cost = (F.col("len").cast("long") * per_slot + gap).alias("cost")
    size = max(1, -(-nodes.count() // n))
    cut = nodes.select("node_id", cost, F.floor((F.col("node_id") - 1) / size).alias("b"))
    totals, at = [], 0
    for r in cut.groupBy("b").agg(F.sum("cost").alias("s")).orderBy("b").collect():  # at most n rows
        totals.append((r["b"], at))
        at += r["s"]
    before = F.broadcast(spark.createDataFrame(totals, "b long, before long"))
    inner = F.sum("cost").over(Window.partitionBy("b").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost")
    return cut.join(before, "b").select("node_id", (inner + F.col("before")).alias("start"))
