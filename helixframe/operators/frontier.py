"""Seed extension as joins: all reads' searches go on together, one level of nodes at a time.

A state is a path that one search has walked: its nodes, its alignment row and the bases it spells.  Per
level, states are joined with the arcs of their last nodes and the texts of the next ones; the rows of all states of a
batch advance together; the best score of every search is kept in a table, and states that can't reach it are dropped.
No graph is held by the driver or by a task, and no row holds more than one path.

Every search runs twice.  The first run keeps the few most promising states of each level, and its best
score bounds the second, which keeps every state that can still reach it.  A search whose states outnumber the visit limit
stops as exhausted, so a level never holds more than the limit times four states of one search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions.align import GAP, MATCH, MISMATCH, align
from ..session import discard, materialise
from .markov import eligible_next

BEAM = 4
OPTIMAL, EXHAUSTED, MULTIPLE = "optimal", "exhausted", "multiple"
_LOW = np.int32(-(1 << 28))


# ---- rows of many alignments at once


def _texts(values: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.uint8)
    for i, v in enumerate(values):
        out[i, : len(v)] = np.frombuffer(v.encode("latin-1", "replace"), np.uint8)
    return out


def advance(patterns: list[str], rows: np.ndarray, parts: list[str]):
    """Rows after each part, and of each part: the best score of the whole pattern within it, how often, and after how many bases first.

    ``rows`` is padded to the longest pattern; what stands beyond a pattern's end never counts.
    """
    lengths, sizes = np.array([len(p) for p in patterns]), np.array([len(p) for p in parts])
    order = np.argsort(-sizes, kind="stable")
    width = rows.shape[1]
    ramp = np.arange(width, dtype=np.int32) * GAP
    pattern, text = _texts([patterns[i] for i in order], width - 1), _texts([parts[i] for i in order], int(sizes.max(initial=0)))
    now, ends = rows[order].astype(np.int32), lengths[order]
    best, times, first = np.full(len(order), _LOW), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    n_code = ord("N")
    for step in range(text.shape[1]):
        live = int((sizes > step).sum())  # the longest parts come first
        base = text[:live, step, None]
        p = pattern[:live]
        score = np.where((p == base) | (p == n_code) | (base == n_code), MATCH, MISMATCH).astype(np.int32)
        row = now[:live]
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + GAP
        np.maximum(row[:, :-1] + score, row[:, 1:] + GAP, out=new[:, 1:])
        new -= ramp
        np.maximum.accumulate(new, axis=1, out=new)
        new += ramp
        now[:live] = new
        whole = new[np.arange(live), ends[:live]]
        more, same = whole > best[:live], whole == best[:live]
        times[:live] = np.where(more, 1, times[:live] + same)
        first[:live] = np.where(more, step + 1, first[:live])
        best[:live] = np.maximum(best[:live], whole)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return now[back], best[back], times[back], first[back]


def attainable(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best score that each row's pattern can still come to."""
    rest = (lengths[:, None] - np.arange(rows.shape[1])) * MATCH
    return np.where(rest >= 0, rows + rest, _LOW).max(axis=1)


_SCORED = "task long, pattern string, context array<int>, chain array<int>, lens array<int>, spelled string, cell binary, top int, score int, times long, text string"


def _score(source):
    """One level: states with the part of their new node become states that have read it."""
    for b in source:
        if not b.num_rows:
            continue
        patterns, parts, spelled, cells = (b.column(c).to_pylist() for c in ("pattern", "part", "spelled", "cell"))
        lengths = np.array([len(p) for p in patterns])
        width = int(lengths.max()) + 1
        rows = np.tile(np.arange(width, dtype=np.int32) * GAP, (len(patterns), 1))
        for i, c in enumerate(cells):
            if c is not None:
                rows[i, : lengths[i] + 1] = np.frombuffer(c, np.int32)
        rows, best, times, first = advance(patterns, rows, parts)
        top = attainable(rows, lengths)
        found = times > 0
        out = [b.column(c) for c in ("task", "pattern", "context", "chain", "lens")]
        out += [pa.array([s + p for s, p in zip(spelled, parts)]), pa.array([rows[i, : n + 1].tobytes() for i, n in enumerate(lengths)], pa.binary()), pa.array(top.astype(np.int32))]
        out += [pa.array(best.astype(np.int32), mask=~found), pa.array(times), pa.array([s + p[:n] for s, p, n in zip(spelled, parts, first.tolist())])]
        yield pa.RecordBatch.from_arrays(out, names=["task", "pattern", "context", "chain", "lens", "spelled", "cell", "top", "score", "times", "text"])


def oriented(node, length, seq, start, size):
    """``size`` bases from ``start`` (from 0) of a signed node's text, turned only as far as asked."""
    behind = F.greatest(length - start - size, F.lit(0))
    taken = F.greatest(length - start - behind, F.lit(0))
    return F.when(node > 0, F.substring(seq, start + 1, size)).otherwise(S.revcomp(F.substring(seq, behind + 1, taken)))


def _longest(best):
    """Bases that a path may spell before its score falls below ``best``."""
    n = F.length("pattern")
    return n + F.floor((n * MATCH - best) / -GAP)


def _level(states: DataFrame, best: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """States (last of ``chain`` not read yet, from base ``at``) with their parts, scored."""
    own = nodes.select(F.col("node_id").alias("id__"), "seq", "len")
    asked = states.join(best.select("task", F.col("score").alias("least__")), "task").withColumn("last", F.element_at("chain", -1))
    met = asked.join(own, F.abs("last") == F.col("id__"))
    room = F.greatest(_longest(F.col("least__")) - F.length("spelled"), F.lit(0)).cast("int")
    part = oriented(F.col("last"), F.col("len"), F.col("seq"), F.col("at"), room)
    lens = F.concat("lens", F.array(F.col("len").cast("int")))
    ready = met.select("task", "pattern", "context", "chain", lens.alias("lens"), "spelled", "cell", part.alias("part"))
    return materialise(ready.mapInArrow(_score, _SCORED), name)


def _run(tasks: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None, bound: bool, visits: int, beam: int | None, best: DataFrame) -> DataFrame:
    """``task, score, times, chain, lens, text, seen``: best of each search; ``best`` is what is known before."""
    empty = F.array().cast("array<int>")
    states = tasks.select("task", "pattern", "context", F.array("last").alias("chain"), empty.alias("lens"), F.lit("").alias("spelled"), F.lit(None).cast("binary").alias("cell"), F.col("offset").alias("at"))
    best = materialise(best.select("task", "score", F.lit(0).cast("long").alias("times"), empty.alias("chain"), empty.alias("lens"), F.lit("").alias("text"), F.lit(0).cast("long").alias("seen")), "best")
    while True:
        scored = _level(states, best, nodes, "scored")
        entry = lambda df, seen: df.select("task", F.struct("score", "times", F.struct("text", "chain", "lens").alias("path")).alias("x"), seen.alias("seen"))
        known = entry(best, F.col("seen"))
        both = known.unionByName(entry(scored.filter("score IS NOT NULL"), F.lit(0).cast("long"))).unionByName(scored.select("task", F.lit(None).cast(known.schema["x"].dataType).alias("x"), F.lit(1).cast("long").alias("seen")))
        top = both.groupBy("task").agg(F.max("x.score").alias("top"))
        joined = both.join(top, "task")
        at_top = F.col("x.score") == F.col("top")
        # a path of a search's first score is none: the pattern isn't begun
        summed = joined.groupBy("task").agg(F.first("top").alias("score"), F.sum(F.when(at_top, F.col("x.times"))).alias("times"), F.min(F.when(at_top & (F.col("x.times") > 0), F.col("x.path"))).alias("path"), F.sum("seen").alias("seen"))
        new = materialise(summed.select("task", "score", F.coalesce("times", F.lit(0)).cast("long").alias("times"), F.coalesce("path.chain", empty).alias("chain"), F.coalesce("path.lens", empty).alias("lens"), F.coalesce("path.text", F.lit("")).alias("text"), "seen"), "best")
        left = scored.join(new.filter(F.col("seen") <= visits).select("task", F.col("score").alias("least__")), "task")
        left = left.filter(F.length("spelled") < _longest(F.col("least__")))
        if bound:
            left = left.filter(F.col("top") >= F.col("least__"))
        if beam is not None:
            w = Window.partitionBy("task").orderBy(F.desc("top"), "spelled", "chain")
            left = left.withColumn("place__", F.row_number().over(w)).filter(F.col("place__") <= beam)
        left = materialise(left.select("task", "pattern", "context", "chain", "lens", "spelled", "cell"), "front")
        discard(best, scored)
        best = new
        if left.isEmpty():
            return best
        states = _children(left, arcs, k, markov)


def _children(front: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None) -> DataFrame:
    links = arcs.select(F.col("src").alias("last"), F.col("dst").alias("next_node")).distinct()
    kept = ["task", "pattern", "context", "chain", "lens", "spelled", "cell"]
    if markov is None:
        steps = front.withColumn("last", F.element_at("chain", -1)).join(links, "last")
    else:
        paths = front.select("task", F.col("chain").alias("own__"), F.concat("context", "chain").alias("chain"))
        allowed = eligible_next(paths, markov, arcs, ["task", "own__"]).select("task", F.col("own__").alias("chain"), "next_node")
        steps = front.join(allowed, ["task", "chain"])
    return steps.select(*[c for c in kept if c != "chain"], F.concat("chain", F.array("next_node")).alias("chain"), F.lit(k - 1).alias("at"))


def search_all(tasks: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None = None, bound: bool = True, visits: int = 5000) -> DataFrame:
    """``task, score, chain, lens, text, state``: the best path for each pattern, as the search of one read finds it.

    tasks: ``task, pattern, last, offset, context``: the pattern goes on from base ``offset`` of the signed node ``last``, to which
    the nodes of ``context`` led.  ``chain`` begins with ``last``; its nodes' lengths are ``lens``.  An empty text means that no
    path is better than none.  Of several best paths the one of the smallest text is given, and the state is
    ``multiple``; beyond the visit limit it is ``exhausted``.
    """
    tasks = materialise(tasks.filter(F.length("pattern") > 0), "tasks")
    none = tasks.select("task", (F.length("pattern") * GAP).cast("int").alias("score"))
    quick = _run(tasks, nodes, arcs, k, markov, bound, visits, BEAM, none)
    done = _run(tasks, nodes, arcs, k, markov, bound, visits, None, quick.select("task", "score"))
    own = tasks.select("task", (F.length("pattern") * GAP).cast("int").alias("first__"))
    state = F.when(F.col("seen") > visits, EXHAUSTED).when((F.col("times") > 1) & (F.col("score") > F.col("first__")), MULTIPLE).otherwise(OPTIMAL)
    return done.join(own, "task").select("task", "score", "chain", "lens", "text", state.alias("state"))


# ---- both sides of a seed


def _place(lens, at: int, k: int) -> tuple[int, int]:
    """Index of the node that holds a path's ``at``-th k-mer, and the k-mer's place there."""
    depth = 0
    while depth + 1 < len(lens) and at >= (own := lens[depth] - k + 1):
        at -= own
        depth += 1
    return depth, at


_SIDE = "task long, rec_id long, seed_rank int, read string, chain array<int>, lens array<int>, node_first int, read_first int, count int, cover int, own int, room int, exhausted boolean, several boolean"


def _before_search(k: int):
    """A side made ready: own k-mers given back, the last node followed to its end; ``room`` bases of the read are left to search for."""

    def one(read, chain, lens, node_first, read_first, count, cover, own):
        room = len(read) - read_first - cover
        if room <= 0:
            return chain, lens, count, cover, own, 0
        back = min(k, own - 1)
        count, cover, own, room = count - back, cover - back, own - back, room + back
        depth, at = _place(lens, node_first + count - 1, k)
        more = min(lens[depth] - k - at, room)
        return chain[: depth + 1], lens[: depth + 1], count + more, cover + more, own + more, room - more

    def run(source):
        for pdf in source:
            out = []
            for r in pdf.itertuples(index=False):
                chain, lens, count, cover, own, room = one(r.read, list(r.chain), list(r.lens), r.node_first, r.read_first, r.count, r.cover, r.own)
                out.append((r.task, r.rec_id, r.seed_rank, r.read, chain, lens, r.node_first, r.read_first, count, cover, own, room, r.exhausted, r.several))
            yield pd.DataFrame(out, columns=pdf.columns)

    return run


def _turned(k: int):
    """The same path on the other strand."""

    def run(source):
        for pdf in source:
            out = []
            for r in pdf.itertuples(index=False):
                depth, at = _place(list(r.lens), r.node_first + r.count - 1, k)
                chain, lens = [-int(x) for x in r.chain[: depth + 1]][::-1], [int(x) for x in r.lens[: depth + 1]][::-1]
                read = r.read.translate(_TURN)[::-1]
                out.append((r.task, r.rec_id, r.seed_rank, read, chain, lens, int(r.lens[depth]) - k - at, len(r.read) - r.read_first - r.cover, r.count, r.cover, r.own, 0, r.exhausted, r.several))
            yield pd.DataFrame(out, columns=pdf.columns)

    return run


_TURN = str.maketrans("ACGT", "TGCA")


def _grown(sides: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None, bound: bool, visits: int) -> DataFrame:
    """Sides grown to the right as far as the read goes; an exhausted or vain search adds nothing."""
    ready = materialise(sides.mapInPandas(_before_search(k), _SIDE), "sides")
    open_ = ready.filter("room > 0")
    context = F.slice("chain", F.lit(1), F.size("chain") - 1)
    tasks = open_.select("task", F.expr("substring(read, read_first + cover + 1)").alias("pattern"), F.element_at("chain", -1).alias("last"), F.element_at("lens", -1).alias("offset"), context.alias("context"))
    found = search_all(tasks, nodes, arcs, k, markov, bound, visits).select("task", F.col("chain").alias("new_chain"), F.col("lens").alias("new_lens"), "text", "state")
    both = ready.join(found, "task", "left")
    good = F.coalesce((F.col("state") != EXHAUSTED) & (F.col("text") != ""), F.lit(False))
    head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    searched = F.col("room") > 0
    columns = {
        "chain": F.when(good, F.concat(head("chain"), "new_chain")).otherwise(F.col("chain")), "lens": F.when(good, F.concat(head("lens"), "new_lens")).otherwise(F.col("lens")),
        "count": F.when(good, F.col("count") + F.length("text")).otherwise(F.col("count")), "cover": F.when(good, F.col("cover") + F.col("room")).otherwise(F.col("cover")),
        "exhausted": F.col("exhausted") | (searched & ~good), "several": F.col("several") | (good & (F.col("state") == MULTIPLE)),
    }
    return both.select(*[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ready.schema.fields])


def extend_seeds(reads: DataFrame, seeds: DataFrame, nodes: DataFrame, arcs: DataFrame, k: int, markov: DataFrame | None = None, bound: bool = True, visits: int = 5000) -> DataFrame:
    """``rec_id, score, chain, pos_first, pos_last, corrected, state, seeds``: each read's best extension, as :func:`extend.align_reads` gives it.

    The right side grows on the read, then the left one on its reverse complement; the path's letters are then fetched piece by piece.
    """
    nodes = nodes.select("node_id", "seq", F.length("seq").alias("len"))
    numbered = seeds.select("rec_id", F.col("seed_rank").cast("int").alias("seed_rank"), "chain", "node_first", "read_first", "read_end")
    wide = numbered.join(reads.select("rec_id", F.col("seq").alias("read")), "rec_id").withColumn("task", F.monotonically_increasing_id())
    wide = materialise(wide, "seeds")
    steps = wide.select("task", F.posexplode("chain").alias("at", "node")).withColumn("id__", F.abs("node")).join(nodes.select(F.col("node_id").alias("id__"), "len"), "id__")
    lens = steps.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("at", "len"))).alias("x")).select("task", F.transform("x", lambda v: v["len"].cast("int")).alias("lens"))
    count = F.col("read_end") - F.col("read_first")
    sides = wide.join(lens, "task").select("task", "rec_id", "seed_rank", "read", "chain", "lens", "node_first", "read_first", count.alias("count"), (count + k - 1).alias("cover"), count.alias("own"), F.lit(0).alias("room"), F.lit(False).alias("exhausted"), F.lit(False).alias("several"))
    for _ in range(2):
        grown = _grown(sides, nodes, arcs, k, markov, bound, visits)
        sides = materialise(grown.mapInPandas(_turned(k), _SIDE), "sides")
    path = _path_texts(sides, nodes, k)

    def finish(source):
        for pdf in source:
            out = []
            for r in pdf.itertuples(index=False):
                corrected = r.read[: r.read_first] + r.path + r.read[r.read_first + r.cover :]
                depth, at = _place(list(r.lens), r.node_first + r.count - 1, k)
                state = EXHAUSTED if r.exhausted else MULTIPLE if r.several else OPTIMAL
                out.append((r.rec_id, r.seed_rank, align(r.read, corrected).score - (len(r.read) - r.cover), list(r.chain[: depth + 1]), r.node_first, at + k, corrected, state))
            yield pd.DataFrame(out, columns=["rec_id", "seed_rank", "score", "chain", "pos_first", "pos_last", "corrected", "state"])

    done = sides.join(path, "task").mapInPandas(finish, "rec_id long, seed_rank int, score int, chain array<int>, pos_first int, pos_last int, corrected string, state string")
    made = F.struct("score", (-F.col("seed_rank")).alias("early"), "chain", "pos_first", "pos_last", "corrected", "state")
    return done.groupBy("rec_id").agg(F.max(made).alias("x"), F.count(F.lit(1)).cast("int").alias("seeds")).select("rec_id", "x.score", "x.chain", "x.pos_first", "x.pos_last", "x.corrected", "x.state", "seeds")


def _path_texts(sides: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``task, path``: the bases of each path from its first k-mer to its last, only those from each node."""
    starts = F.transform(F.sequence(F.lit(0), F.size("lens") - 1), lambda i: F.aggregate(F.slice("lens", F.lit(1), i), F.lit(0), lambda a, n: a + n - (k - 1)))
    each = sides.select("task", "node_first", (F.col("node_first") + F.col("count") + k - 1).alias("stop"), F.posexplode(F.arrays_zip(F.col("chain").alias("node"), F.col("lens").alias("len"), starts.alias("start"))).alias("at", "x"))
    first = F.greatest(F.col("node_first") - F.col("x.start"), F.when(F.col("at") == 0, 0).otherwise(k - 1))
    size = F.least(F.col("stop") - F.col("x.start"), F.col("x.len")) - first
    pieces = each.select("task", "at", F.col("x.node").alias("node"), F.abs("x.node").alias("id__"), first.alias("first"), size.alias("size")).filter("size > 0")
    met = pieces.join(nodes.select(F.col("node_id").alias("id__"), "seq", "len"), "id__")
    text = oriented(F.col("node"), F.col("len"), F.col("seq"), F.col("first"), F.col("size"))
    joined = met.select("task", "at", text.alias("text")).groupBy("task").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    return joined.select("task", F.array_join(F.transform("x", lambda v: v["text"]), "").alias("path"))
