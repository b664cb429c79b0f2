"""Mapping reads onto the graph: seed extension, first and second pass.

Scale: a graph of at most ``BROADCAST_BASES`` bases (counted first) is sent to every task once.  Of
a larger one, the searches of all reads go on together by joins, one level at a time
(:mod:`.frontier`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.align import GAP, MATCH, Rows, _codes, align
from ..functions.text import alignment_info
from ..session import materialise
from . import frontier
from . import seeds as seeding
from .markov import ORDERS

VISITS = 5000
#: Graphs with so many bases and arcs or fewer are broadcast, about 100 MB in a task.
BROADCAST_BASES, BROADCAST_ARCS = 32_000_000, 1_000_000
OPTIMAL, EXHAUSTED, MULTIPLE = "optimal", "exhausted", "multiple"


class LocalGraph:
    """A read's part of the graph: signed node sequences, right arcs, accepted transitions."""

    def __init__(self, k: int, nodes: dict[int, str], arcs: dict[int, list[int]], markov: dict | None = None):
        self.k, self.nodes, self.arcs, self.markov = k, nodes, arcs, markov

    def allowed(self, chain: tuple[int, ...]) -> list[int]:
        """Next nodes; with a Markov table, those that the longest known suffix accepts (all if none is known)."""
        out = sorted(self.arcs.get(chain[-1], ()))
        if self.markov is None or len(out) < 2:
            return out
        for order in sorted(ORDERS, reverse=True):
            if len(chain) >= order and (known := self.markov.get(chain[-order:])) is not None:
                return [x for x in out if x in known]
        return out


def search(graph: LocalGraph, pattern: str, start: tuple[int, ...], offset: int, bound: bool = True, visits: int = VISITS, guided: bool = True, target: int | None = None):
    """Best path for ``pattern`` from base ``offset`` of the start chain's last node: (score, chain, bases taken, state).

    Best-first: children are tried by relative, then absolute score, then node id; a branch whose
    attainable score is below the best (at most the best, unguided) is cut.  An exhausted visit
    budget is reported before ties; ties are two or more complete paths of the best score.
    """
    if not pattern:
        return 0, start, "", OPTIMAL
    rows = Rows(pattern)
    first = rows.first
    best = (int(first[-1]), start, "")
    ties: set = set()
    stack = [(start, first, graph.nodes[start[-1]][offset:], "")]
    seen = 0
    while stack:
        chain, row, text, spelled = stack.pop()
        seen += 1
        if seen > visits:
            return (*best, EXHAUSTED)
        for i, base in enumerate(_codes(text).tolist(), 1):
            row = rows.after(row, base)
            score = int(row[-1])
            if target is not None and chain[-1] != target:
                continue
            if score > best[0]:
                best, ties = (score, chain, spelled + text[:i]), {(chain, spelled + text[:i])}
            elif score == best[0] and score > int(first[-1]):
                ties.add((chain, spelled + text[:i]))
        top = rows.attainable(row)
        if bound and (top < best[0] if guided else top <= best[0]):
            continue
        if len(spelled) + len(text) > len(pattern) + (len(pattern) * MATCH - best[0]) // -GAP + graph.k:
            continue
        children = []
        for node in graph.allowed(chain) if guided else sorted(graph.arcs.get(chain[-1], ())):
            more = graph.nodes.get(node)
            if more is not None:
                part = more[graph.k - 1 :]
                near = row
                for base in _codes(part[:8]).tolist():
                    near = rows.after(near, base)
                top = rows.attainable(near)
                children.append((top / max(1, len(pattern)), top, -node, node, part))
        for _, _, _, node, part in sorted(children):
            stack.append((chain + (node,), row, part, spelled + text))
    return (*best, MULTIPLE if len(ties) > 1 else OPTIMAL)


def _flip(chain: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(-x for x in reversed(chain))


_TURN = str.maketrans("ACGT", "TGCA")


def _rc(s: str) -> str:
    return s.translate(_TURN)[::-1]


def _place(graph: LocalGraph, chain: tuple[int, ...], at: int) -> tuple[int, int]:
    """Index of the chain's node that holds its ``at``-th k-mer (from the first node's start), and the k-mer's place there."""
    depth = 0
    while depth + 1 < len(chain) and at >= (own := len(graph.nodes[chain[depth]]) - graph.k + 1):
        at -= own
        depth += 1
    return depth, at


def _grow(graph: LocalGraph, read: str, chain: tuple[int, ...], node_first: int, read_first: int, count: int, cover: int, own: int, bound: bool, visits: int):
    """A path grown to the right: (chain, k-mers of the path, bases of the read it stands for, of the path's k-mers those without gaps, state).

    Up to k k-mers at its end are given back, as far as they are ``own`` ones (one stays), the last
    node is followed to its end, and the rest of the read is searched from there.  An exhausted
    search adds nothing.
    """
    k, room = graph.k, len(read) - read_first - cover
    if room <= 0:
        return chain, count, cover, own, OPTIMAL
    back = min(k, own - 1)
    count, cover, own, room = count - back, cover - back, own - back, room + back
    depth, at = _place(graph, chain, node_first + count - 1)
    chain = chain[: depth + 1]
    more = min(len(graph.nodes[chain[-1]]) - k - at, room)
    count, cover, own, room = count + more, cover + more, own + more, room - more
    if not room:
        return chain, count, cover, own, OPTIMAL
    _, found, text, state = search(graph, read[read_first + cover :], chain, len(graph.nodes[chain[-1]]), bound, visits)
    if state == EXHAUSTED or not text:
        return chain, count, cover, own, EXHAUSTED
    return found, count + len(text), cover + room, own, state


def extend_seed(graph: LocalGraph, read: str, chain: list[int], node_first: int, read_first: int, read_end: int, bound: bool = True, visits: int = VISITS):
    """(score, chain, position in the first node, position in the last, corrected read, state) of one seed.

    The right side grows on the read, then the left side on its reverse complement.  What the path
    does not stand for keeps the read's bases, and their number is subtracted from the score.  Where
    the read has gaps, the corrected read is longer or shorter than it.
    """
    k = graph.k

    def turned(chain, node_first, read_first, count, cover):
        depth, at = _place(graph, chain, node_first + count - 1)
        return _flip(chain[: depth + 1]), len(graph.nodes[chain[depth]]) - k - at, len(read) - read_first - cover

    count = read_end - read_first
    chain, count, cover, own, right = _grow(graph, read, tuple(chain), node_first, read_first, count, count + k - 1, count, bound, visits)
    chain, node_first, read_first = turned(chain, node_first, read_first, count, cover)
    chain, count, cover, _, left = _grow(graph, _rc(read), chain, node_first, read_first, count, cover, own, bound, visits)
    chain, node_first, read_first = turned(chain, node_first, read_first, count, cover)
    path = graph.nodes[chain[0]] + "".join(graph.nodes[n][k - 1 :] for n in chain[1:])
    corrected = read[:read_first] + path[node_first : node_first + count + k - 1] + read[read_first + cover :]
    state = EXHAUSTED if EXHAUSTED in (right, left) else MULTIPLE if MULTIPLE in (right, left) else OPTIMAL
    end = _place(graph, chain, node_first + count - 1)[1] + k
    return align(read, corrected).score - (len(read) - cover), chain, node_first, end, corrected, state


_graphs: dict[str, LocalGraph] = {}  # the last one of this worker, by name


def _whole_graph(nodes: DataFrame, arcs: DataFrame, markov: DataFrame | None):
    """The graph as a broadcast if it is small enough by count, else None."""
    size = nodes.agg(F.sum(F.length("seq")).alias("bases")).first()["bases"] or 0
    if size > BROADCAST_BASES or arcs.limit(BROADCAST_ARCS + 1).count() > BROADCAST_ARCS:
        return None
    if markov is not None and markov.limit(BROADCAST_ARCS + 1).count() > BROADCAST_ARCS:
        return None
    own = nodes.select("node_id", "seq").toArrow()
    links = arcs.select("src", "dst").distinct().toArrow()
    table = None
    if markov is not None:
        table = {}
        for r in markov.select("chain", F.when(F.col("accepted"), F.col("next_node")).alias("next")).toArrow().to_pylist():
            known = table.setdefault(tuple(r["chain"]), set())
            if r["next"] is not None:
                known.add(r["next"])
    plain = (own.column(0).to_pylist(), own.column(1).to_pylist(), links.column(0).to_pylist(), links.column(1).to_pylist(), table)
    return nodes.sparkSession.sparkContext.broadcast(plain)


def _graph_of(held, key: str, k: int) -> LocalGraph:
    if key not in _graphs:
        ids, texts, src, dst, table = held.value
        both = dict(zip(ids, texts))
        both.update({-i: _rc(t) for i, t in zip(ids, texts)})
        right: dict[int, list[int]] = {}
        for a, b in zip(src, dst):
            right.setdefault(a, []).append(b)
        _graphs.clear()
        _graphs[key] = LocalGraph(k, both, right, table)
    return _graphs[key]


def _best(graph: LocalGraph, read: str, seeds, bound: bool, visits: int):
    best = None
    for s in seeds:
        found = extend_seed(graph, read, list(map(int, s["chain"])), int(s["node_first"]), int(s["read_first"]), int(s["read_end"]), bound, visits)
        if best is None or found[0] > best[0]:
            best = found
    return best


_ALIGNED = "rec_id long, score int, chain array<int>, pos_first int, pos_last int, corrected string, state string, seeds int"


def _frame(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["rec_id", "score", "chain", "pos_first", "pos_last", "corrected", "state", "seeds"])


def align_reads(reads: DataFrame, seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None = None, bound: bool = True, visits: int = VISITS) -> DataFrame:
    """``rec_id, score, chain, pos_first, pos_last, corrected, state, seeds``: each read's best extension.

    reads: ``rec_id, seq``; candidates score their alignment to the read; the first of equals wins.
    """
    own = seeds.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("seed_rank", "chain", "node_first", "read_first", "read_end"))).alias("seeds"))
    rows = reads.select("rec_id", "seq").join(own, "rec_id")
    held = _whole_graph(nodes, arcs, markov)
    if held is not None:
        key = uuid.uuid4().hex

        def run(source):
            for pdf in source:
                graph = _graph_of(held, key, k)
                yield _frame([(rec, (b := _best(graph, read, seeds_, bound, visits))[0], list(b[1]), *b[2:], len(seeds_)) for rec, read, seeds_ in pdf[["rec_id", "seq", "seeds"]].itertuples(index=False)])

        return rows.repartition(reads.sparkSession.sparkContext.defaultParallelism * 4, "rec_id").mapInPandas(run, _ALIGNED)
    return frontier.extend_seeds(reads, seeds, nodes, arcs, k, markov, bound, visits)


def kmer_seeds(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    hits = seeding.lookup(reads.select("rec_id", "seq"), seeding.kmer_index(nodes, k), k)
    return seeding.merged_seeds(seeding.islands(hits, arcs))


def mem_seeds(reads: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Exact matches below k bases as seeds (L15, J15): from k - 1 down to 16 until there are enough, merged, the ten longest.

    A match of fewer than k bases counts as the one k-mer at its start.  With k of 16 or less there are none.
    """
    found = seeding.adaptive_matches(seeding.exact_matches(reads, nodes, min(seeding.MEM_LEAST, k)), k)
    lengths = nodes.select(F.col("node_id").alias("node"), "marg_len").unionByName(nodes.select((-F.col("node_id")).alias("node"), "marg_len"))
    whole = seeding.match_seeds(found, lengths, reads.select("rec_id", (F.length("seq") - (k - 1)).alias("read_marg")), k, trimmed=False)
    return seeding.top_seeds(seeding.merged_seeds(whole), trim=k)


def _mapped(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None, mem: bool, bound: bool, visits: int) -> DataFrame:
    """Best extension of k-mer seeds; of exact matches for reads without any, or with a score of half the length at most.

    The second try counts only if its score is above half the length and no search was exhausted.
    """
    found = align_reads(reads, seeding.top_seeds(kmer_seeds(reads, nodes, arcs, k)), nodes, arcs, k, markov, bound, visits)
    if not mem or k <= seeding.MEM_LEAST:
        return found
    found = materialise(found, "by-kmers")
    half = F.floor(F.length("seq") / 2)
    weak = materialise(reads.join(found.select("rec_id", "score", "state"), "rec_id", "left").filter(F.col("score").isNull() | ((F.col("score") <= half) & (F.col("state") != EXHAUSTED))).select("rec_id", "seq"), "weak")
    if weak.isEmpty():
        return found
    again = align_reads(weak, mem_seeds(weak, nodes, k), nodes, arcs, k, markov, bound, visits)
    better = materialise(again.join(weak.select("rec_id", half.alias("half")), "rec_id").filter((F.col("score") > F.col("half")) & (F.col("state") != EXHAUSTED)).drop("half"), "by-matches")
    return found.join(better.select("rec_id"), "rec_id", "left_anti").unionByName(better)


def _judged(reads: DataFrame, found: DataFrame) -> DataFrame:
    joined = reads.select("rec_id", "seq").join(found, "rec_id", "left")
    branch = F.coalesce(F.col("state") == "multiple", F.lit(False))
    good = F.coalesce((F.col("score") > F.length("seq") / 2) & (F.col("state") == "optimal"), F.lit(False))
    return joined.select(
        "rec_id", "seq", good.alias("aligned"), F.coalesce("score", F.lit(0)).alias("score"), branch.alias("branch"),
        F.when(good, F.col("pos_first")).otherwise(0).alias("pos_first"), F.when(good, F.col("pos_last")).otherwise(0).alias("pos_last"),
        F.when(good, F.col("chain")).alias("chain"), F.when(good, F.col("corrected")).otherwise(F.col("seq")).alias("corrected"),
    )


def align_pass1(reads: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, mem: bool = True, bound: bool = True, visits: int = VISITS) -> DataFrame:
    """First pass: best seed extension per read; reads below k bases or without seeds stay as they are.

    ``aligned`` needs a score above half the length and a single optimal path; several optimal
    paths set ``branch`` and leave the read for the second pass.
    """
    return _judged(reads, _mapped(reads.filter(F.length("seq") >= k), nodes, arcs, k, None, mem, bound, visits))


def align_pass2(first: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame, bound: bool = True, visits: int = VISITS, mem: bool = True) -> DataFrame:
    """Second pass: only branching reads are aligned again, along transitions that the Markov table allows."""
    again = first.filter("branch").select("rec_id", "seq")
    return first.filter("not branch").unionByName(_judged(again, _mapped(again, nodes, arcs, k, markov, mem, bound, visits)))


def with_info(alignments: DataFrame) -> DataFrame:
    """The alignment line's tags as a column ``info``."""
    return alignments.withColumn("info", alignment_info(F.col("aligned"), F.col("score"), F.col("branch"), F.col("pos_first"), F.col("pos_last"), F.coalesce("chain", F.array().cast("array<int>"))))


def alignment_metrics(alignments: DataFrame, k: int) -> DataFrame:
    """One row of totals (A05); reads below k bases are not counted; substitutions are (length - score) / 2."""
    seen = alignments.filter(F.length("seq") >= k)
    subs = F.when(F.col("aligned"), F.floor((F.length("seq") - F.col("score")) / 2)).otherwise(0)
    return seen.agg(F.count(F.lit(1)).alias("num_reads"), F.avg(F.length("seq")).alias("avg_read_len"), F.max(F.length("seq")).alias("max_read_len"), F.coalesce(F.sum(subs), F.lit(0)).alias("num_substitutions"), F.count_if("aligned").alias("num_corr_reads"))
