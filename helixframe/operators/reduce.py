"""Repeats taken apart by the paths that go through them: reductions found, chosen and applied to graph and chains together.

A reduction is a path A, B, ..., X, Y such that A has one right arc only, to B, every chain that goes
from A to B goes on along the path as far as it reaches, and so does, backwards, every chain that
comes from X to Y.  It is applied by giving A the sequence of A to X and an arc to Y in place of
A -> B and X -> Y; chains pass from A to Y directly.

Paths grow by a node a level for all A together: an index of the chains' places (a row for each
place) is joined by chain and place, and a level's nodes are compared by their minimum and maximum,
so no group of chains is ever in one task.  A round applies reductions that don't touch each other's
nodes; each shortens a chain, so rounds end by themselves.

Paths that come back to A or to its other strand are left, as are ends that lie on the path already
and hairpins.  Null or empty chains have no places; chains of one node stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from ..session import discard, materialise
from .graph import rewire, spell
from .markov import reverse_chain


def place_index(chains: DataFrame, key: str = "chain_id") -> DataFrame:
    """``key, pos, node, next``: every place of every chain, from 1."""
    return chains.select(key, "chain", F.posexplode("chain").alias("p", "node")).select(key, (F.col("p") + 1).alias("pos"), "node", F.get("chain", F.col("p") + 1).alias("next"))


def _steps(index: DataFrame, key: str) -> DataFrame:
    """``key, x, y, at, way``: each step of two nodes on either strand, and where its second node is; ``way`` leads on."""
    there = index.filter("next is not null")
    back = there.select(key, (-F.col("next")).alias("x"), (-F.col("node")).alias("y"), F.col("pos").alias("at"), F.lit(-1).alias("way"))
    return there.select(key, F.col("node").alias("x"), F.col("next").alias("y"), (F.col("pos") + 1).alias("at"), F.lit(1).alias("way")).unionByName(back)


def _agreed(candidates: DataFrame, steps: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """Candidates (``a, path``) whose last step's chains all come along the path, one of them from its beginning."""
    n, c = F.size("path"), F.col("chain")
    asked = candidates.select("a", "path", F.element_at("path", -2).alias("x"), F.element_at("path", -1).alias("y"))
    seen = asked.join(steps, ["x", "y"]).join(chains.select(key, "chain"), key)
    first = F.greatest(F.col("at") - n + 1, F.lit(1))
    window = F.when(F.col("way") == 1, F.slice(c, first, F.col("at") - first + 1)).otherwise(reverse_chain(F.slice(c, F.col("at"), n)))
    held = seen.select("a", "path", window.alias("w"))
    same = F.col("w") == F.slice("path", F.size("path") - F.size("w") + 1, F.size("w"))
    judged = held.groupBy("a").agg(F.bool_and(same).alias("all"), F.max(F.size("w") - F.size("path")).alias("least"))
    return candidates.join(judged.filter("all and least = 0").select("a"), "a", "left_semi")


def find_reductions(arcs: DataFrame, chains: DataFrame, key: str = "chain_id", index: DataFrame | None = None) -> DataFrame:
    """``a, path``: the shortest reduction of each node; of two that are each other's reverse, the smaller.

    arcs: ``src, dst`` over signed nodes, both strands; chains: ``key, chain``.
    """
    own = index is None
    index = materialise(place_index(chains, key), "places") if own else index
    known = arcs.select("src", "dst").distinct()
    single = known.groupBy(F.col("src").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("b")).filter("n = 1").select("a", "b")
    steps = materialise(_steps(index, key), "steps")
    follows = materialise(steps.join(single, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).select("a", key, "at", "way"), "follows")
    front = materialise(single.join(follows.select("a").distinct(), "a", "left_semi").filter("abs(a) <> abs(b)").select("a", F.array("a", "b").alias("path")), "front")
    found = None
    while True:
        place = index.select(key, F.col("pos").alias("at__"), F.col("node").alias("there"))
        ahead = follows.join(place, (follows[key] == place[key]) & (F.col("at") + F.col("way") == F.col("at__"))).select("a", follows[key], F.col("at__").alias("at"), "way", (F.col("there") * F.col("way")).alias("y"))
        ahead = materialise(ahead, "follows")
        agreed = ahead.groupBy("a").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other and abs(y) <> abs(a)").select("a", "y")
        grown = materialise(front.join(agreed, "a").select("a", F.concat("path", F.array("y")).alias("path")), "front")
        discard(follows, front)
        if grown.isEmpty():
            discard(ahead, grown)
            break
        last = F.element_at("path", -1)
        fresh = grown.filter(~F.exists(F.slice("path", F.lit(1), F.size("path") - 1), lambda n: F.abs(n) == F.abs(last)))
        good = materialise(_agreed(fresh, steps, chains, key), "reductions")
        found = good if found is None else found.unionByName(good)
        front = materialise(grown.join(good.select("a"), "a", "left_anti"), "front")
        follows = materialise(ahead.join(front.select("a"), "a", "left_semi"), "follows")
        discard(grown, ahead)
    discard(steps, *([index] if own else []))
    if found is None:
        return arcs.sparkSession.createDataFrame([], "a int, path array<int>")
    many = known.groupBy(F.col("dst").alias("y")).agg(F.count(F.lit(1)).alias("into")).filter("into > 1").select("y", F.lit(True).alias("many"))
    ended = found.withColumn("y", F.element_at("path", -1)).join(many, "y", "left")
    return ended.filter(F.coalesce("many", F.lit(False)) | (F.col("path") < reverse_chain(F.col("path")))).select("a", "path")


def apart(found: DataFrame) -> DataFrame:
    """Reductions that can be applied together: the least of all whose ends meet, or whose end lies within another.

    Each is held against the least at each of its nodes, so no pairs are made; the least of all always stays.
    """
    ends = F.array(F.col("path")[0], F.element_at("path", -1))
    inner = F.slice("path", F.lit(2), F.size("path") - 2)
    uses = found.select("path", F.explode(F.concat(F.transform(ends, lambda n: F.struct(F.abs(n).alias("node"), F.lit(True).alias("end"))), F.transform(F.array_distinct(F.transform(inner, F.abs)), lambda n: F.struct(n.alias("node"), F.lit(False).alias("end"))))).alias("u")).select("path", "u.*")
    least = uses.groupBy("node").agg(F.min(F.when(F.col("end"), F.col("path"))).alias("least_end"), F.min(F.when(~F.col("end"), F.col("path"))).alias("least_inner"))
    met = uses.join(least, "node")
    lost = (F.col("least_end") < F.col("path")) | (F.col("end") & (F.col("least_inner") < F.col("path")))
    return found.join(met.filter(F.coalesce(lost, F.lit(False))).select("path").distinct(), "path", "left_anti").select(found.columns)


def reduce_arcs(arcs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Arcs after reductions: A -> Y, with the coverage of X -> Y, in place of A -> B and X -> Y."""
    p = F.col("path")
    ends = chosen.select(p[0].alias("a"), p[1].alias("b"), F.element_at(p, -2).alias("x"), F.element_at(p, -1).alias("y"))
    gone = ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(ends.select(F.col("x").alias("src"), F.col("y").alias("dst")))
    left = rewire(arcs, gone)
    rest = [c for c in arcs.columns if c not in ("src", "dst")]
    step = lambda x, y: arcs.select(F.col("src").alias(x), F.col("dst").alias(y), *rest)
    there = ends.join(step("x", "y"), ["x", "y"]).select(F.col("a").alias("src"), F.col("y").alias("dst"), *rest)
    back = ends.select((-F.col("a")).alias("to"), (-F.col("b")).alias("from"), (-F.col("y")).alias("src")).join(step("from", "to"), ["from", "to"]).select("src", F.col("to").alias("dst"), *rest)
    return left.select("src", "dst", *rest).unionByName(there).unionByName(back)


def reduce_chains(chains: DataFrame, chosen: DataFrame, index: DataFrame, key: str = "chain_id") -> tuple[DataFrame, DataFrame]:
    """Chains after reductions, and the keys of those that changed.

    What lies between A and Y goes, whole or cut off by a chain's end; a chain that comes from within to Y begins with A.
    """
    p = F.col("path")
    m = F.size(p) - 2
    a, b, x, y = p[0], p[1], F.element_at(p, -2), F.element_at(p, -1)
    none = F.lit(None).cast("int")
    edit = lambda u, v, on, end: F.struct(u.alias("node"), v.alias("next"), m.alias("m"), F.lit(on).alias("on"), end.cast("int").alias("end"))
    edits = chosen.select(F.explode(F.array(edit(a, b, True, none), edit(-b, -a, False, none), edit(x, y, False, a), edit(-y, -x, True, -a))).alias("e")).select("e.*")
    hit = index.filter("next is not null").join(edits, ["node", "next"])
    first = F.when(F.col("on"), F.col("pos") + 1).otherwise(F.col("pos") + 1 - F.col("m"))  # without the one before or after, the chain's end is within
    changed = hit.groupBy(key).agg(F.collect_set(F.struct(first.alias("first"), (first + F.col("m") - 1).alias("last"), "end", "on")).alias("cuts"))  # at most four a place of the chain
    c = F.col("chain")
    gone = lambda i: F.exists("cuts", lambda u: (i + 1 >= u["first"]) & (i + 1 <= u["last"]))
    kept = F.filter(c, lambda _, i: ~gone(i))
    front = F.transform(F.filter("cuts", lambda u: u["end"].isNotNull() & ~u["on"] & (u["first"] <= 1)), lambda u: u["end"])
    tail = F.transform(F.filter("cuts", lambda u: u["end"].isNotNull() & u["on"] & (u["last"] >= F.size(c))), lambda u: u["end"])
    both = chains.join(changed, key, "left")
    new = F.when(F.col("cuts").isNull(), c).otherwise(F.concat(front, kept, tail))
    return both.select(*(new.alias("chain") if n == "chain" else F.col(n) for n in chains.columns)), changed.select(key)


def reduce_nodes(nodes: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """Nodes after reductions: A holds the sequence of A to X; coverages stay."""
    paths = chosen.select(F.col("path")[0].alias("a"), F.slice("path", F.lit(1), F.size("path") - 1).alias("chain"))
    spelled = spell(paths, nodes, k, ["a"])
    longer = spelled.select(F.abs("a").cast("int").alias("node_id"), F.when(F.col("a") < 0, S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("longer"))
    seq = F.coalesce("longer", "seq")
    made = {"seq": seq, "len": F.length(seq), "marg_len": S.marginal_length(seq, k)}
    return nodes.join(longer, "node_id", "left").select(*((made[c].cast(nodes.schema[c].dataType).alias(c)) if c in made else F.col(c) for c in nodes.columns))


def reduce_round(nodes: DataFrame, arcs: DataFrame, chains: DataFrame, k: int, key: str = "chain_id", index: DataFrame | None = None):
    """Nodes, arcs, chains and place index after one round, and what was applied; None if nothing can be."""
    index = materialise(place_index(chains, key), "places") if index is None else index
    chosen = materialise(apart(find_reductions(arcs, chains, key, index)), "chosen")
    if chosen.isEmpty():
        discard(chosen)
        return None
    new, changed = reduce_chains(chains, chosen, index, key)
    changed = materialise(changed, "changed")
    new = materialise(new, "chains")
    moved = place_index(new.join(changed, key, "left_semi"), key)
    delta = materialise(index.join(changed, key, "left_anti").unionByName(moved), "places")  # only changed chains are indexed anew
    discard(changed)
    return materialise(reduce_nodes(nodes, chosen, k), "nodes"), materialise(reduce_arcs(arcs, chosen), "arcs"), new, delta, chosen


def reduce_all(nodes: DataFrame, arcs: DataFrame, chains: DataFrame, k: int, key: str = "chain_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, arcs and chains when no reduction is left; each round shortens a chain."""
    own, index = (), None
    while True:
        done = reduce_round(nodes, arcs, chains, k, key, index)
        if done is None:
            discard(index)
            return nodes, arcs, chains
        discard(index, *own, done[4])
        own = nodes, arcs, chains = done[:3]
        index = done[3]
