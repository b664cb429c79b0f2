"""Exact top-k inner-product search by a three-phase uniform threshold (operator 9).

A score is the sum of ``PARTS`` partial scores over slices of the dimensions, and each block of
candidates holds a score list for every slice.

1. Every block scores its rows of greatest norm, an eighth of them, and sends each query's best: the
   k-th best of all that is sent is a lower bound of the query's final k-th best.
2. That safe cutoff is broadcast with the queries.  A block knows the greatest norm of each slice's
   rows; where these cannot reach the cutoff for a query, nothing is scored.  Of what is scored, an entry is sufficient
   if one of its partial scores reaches the cutoff's uniform share.
3. Sufficient entries whose sum can reach the cutoff are resolved exactly, in whole numbers, and
   each block's k best that reach it are merged.

Products are taken in doubles.  Where their sums may pass 2^53 every comparison allows for the
largest error, and phase 3 uses Python's whole numbers, so the result is exact at any magnitude.

Queries are broadcast by bounded groups, and every group meets all rows in one scan of two passes;
each group's result is written before the next begins.  Nothing that is sent grows faster than
k * queries * blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tuned

PARTS = 2
#: Bytes of queries that are broadcast at once, and queries that are multiplied at once.
GROUP_BYTES = 64 << 20
QUERY_BLOCK = 1024
TILE_ROWS = 2048
#: Rows of a tile, by falling norm, that share a bound.
BOUND_ROWS = 256
#: A tile's share of rows that phase 1 scores.
LEAD = 8
SCALE = 256
MOST = 2**63 - 1


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) as whole numbers of 64 bits (beyond, their nearest); unusable vectors and null ids are left out."""
    x = F.col(vector_column)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(math.inf))
    usable = x.isNotNull() & F.col(id_column).isNotNull() & ~F.exists(x, bad)
    return df.filter(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def _matrix(lists, width: int | None = None) -> np.ndarray:
    """Rows padded with 0 to one width: a component that a vector lacks adds nothing."""
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = max(int(lengths.max(initial=0)), 1) if width is None else width
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < width
    out[np.repeat(np.arange(len(lengths)), lengths)[inside], at[inside]] = values[inside]
    return out


def _slices(width: int) -> list[slice]:
    cuts = [width * i // PARTS for i in range(PARTS + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


class Side:
    """Ids and whole-number rows, their doubles, and each slice's norms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.floats = ids, rows, rows.astype(np.float64)
        self.norms = np.stack([np.sqrt((self.floats[:, s] ** 2).sum(1)) for s in _slices(rows.shape[1])], axis=1) * (1 + 1e-9)

    def take(self, at) -> Side:
        out = object.__new__(Side)
        out.ids, out.rows, out.floats, out.norms = self.ids[at], self.rows[at], self.floats[at], self.norms[at]
        return out


def exact(q: Side, c: Side, r: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the pairs (query r, candidate at) in 64 bits; those beyond stop at -2^63 and 2^63 - 1."""
    out = np.empty(len(r), np.int64)
    for low in range(0, len(r), 1 << 14):
        x, y = q.rows[r[low : low + (1 << 14)]], c.rows[at[low : low + (1 << 14)]]
        if _sum_bound(x.astype(np.float64), y.astype(np.float64)) < 2**62:
            out[low : low + len(x)] = np.einsum("ij,ij->i", x, y)
        else:
            out[low : low + len(x)] = [max(-MOST - 1, min(MOST, sum(a * b for a, b in zip(u, v)))) for u, v in zip(x.tolist(), y.tolist())]
    return out


def _sum_bound(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]


def _slack(q: Side, c: Side) -> np.ndarray | float:
    """How far a score in doubles may be from the exact one: nowhere while every sum fits a double."""
    if _sum_bound(q.floats, c.floats) < 2**53:
        return 0.0
    return (q.floats.shape[1] + 8) * 2.0**-51 * np.outer(q.norms.sum(1), c.norms.sum(1))


def _floor_of(cutoff: np.ndarray) -> np.ndarray:
    """Cutoffs as doubles that are no larger; a score at the lower end of 64 bits may stand for less, so there is no cutoff at it."""
    low = cutoff.astype(np.float64)
    low = np.where(np.abs(low) >= 2**53, np.nextafter(low, -np.inf), low)
    return np.where(cutoff == -MOST - 1, -np.inf, low)


def _own(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal ids; the queries' ids are distinct and ascending."""
    at = np.minimum(np.searchsorted(q.ids, c.ids), len(q.ids) - 1)
    cols = np.flatnonzero(q.ids[at] == c.ids)
    return at[cols], cols


def _k_best(rows, ids, scores, k: int):
    """The k best of each row number, ties to the smaller id."""
    order = np.lexsort((ids, -scores.astype(np.float64), rows)) if not len(scores) or int(np.abs(scores.astype(np.float64)).max()) < 2**53 else np.array(sorted(range(len(scores)), key=lambda i: (int(rows[i]), -int(scores[i]), int(ids[i]))))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, int)
    keep = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < k
    return rows[keep], ids[keep], scores[keep]


def leaders(q: Side, tile: Side, k: int):
    """Phase 1: query numbers, ids and exact scores of a tile's local lists."""
    n = max(k + 1, len(tile.ids) // LEAD)
    c = tile.take(np.argsort(-tile.norms.sum(1), kind="stable")[:n])
    score = q.floats @ c.floats.T
    score[_own(q, c)] = -np.inf
    n = min(k, score.shape[1])
    lead = np.argpartition(-score, n - 1, axis=1)[:, :n]
    r, at = np.repeat(np.arange(len(q.ids)), n), lead.ravel()
    kept = score[r, at] > -np.inf
    r, at = r[kept], at[kept]
    return r, c.ids[at], exact(q, c, r, at)


def sufficient(q: Side, cutoff: np.ndarray, tile: Side, k: int):
    """Phases 2 and 3: query numbers, ids and exact scores of a tile's entries that reach the cutoffs, at most k for each query; and the number of cells that were scored."""
    low, found, cells = _floor_of(cutoff), [], 0
    order = np.argsort(-tile.norms.sum(1), kind="stable")
    for a in range(0, len(order), BOUND_ROWS):
        c = tile.take(order[a : a + BOUND_ROWS])
        rows = np.flatnonzero(q.norms @ c.norms.max(axis=0) >= low)
        if not len(rows):
            continue
        own, least = q.take(rows), low[rows][:, None]
        cells += len(rows) * len(c.ids)
        lists = [own.floats[:, s] @ c.floats[:, s].T for s in _slices(own.floats.shape[1])]
        slack = _slack(own, c)
        enough = np.zeros(lists[0].shape, bool)
        for partial in lists:
            enough |= partial * len(lists) >= least - len(lists) * slack
        enough[_own(own, c)] = False
        r, at = np.nonzero(enough)
        possible = sum(partial[r, at] for partial in lists) >= least[r, 0] - (slack if isinstance(slack, float) else slack[r, at])
        r, at = r[possible], at[possible]
        score = exact(own, c, r, at)
        reach = score >= cutoff[rows[r]]
        found.append(_k_best(rows[r[reach]], c.ids[at[reach]], score[reach], k))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), cells
    return *_k_best(*map(np.concatenate, zip(*found)), k), cells


def _tiles(source, width: int):
    held, rows = [], 0
    for b in source:
        held.append(b)
        rows += b.num_rows
        if rows >= TILE_ROWS:
            yield _side(held, width)
            held, rows = [], 0
    if rows:
        yield _side(held, width)


def _side(batches, width: int | None = None) -> Side:
    t = pa.Table.from_batches(batches).combine_chunks()
    return Side(np.asarray(t.column("vec_id").chunk(0), np.int64), _matrix(t.column("v").chunk(0), width))


def _merged(held: list, k: int) -> list:
    return [_k_best(*map(np.concatenate, zip(*held)), k)] if held else []


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query over all other rows.

    Both frames are ``vec_id, v`` as :func:`quantised` makes them.  All rows with the query's own id
    are left out; ties go to the smaller id; a query with fewer candidates gets all.  Repeated
    candidate rows each count; repeated query ids are one query (its first vector by value).
    Vectors of unlike length are compared as if the shorter ended in zeros.  Scores beyond 64 bits
    count as -2^63 or 2^63 - 1, ties among them to the smaller id.
    """
    spark = tuned(vectors.sparkSession)
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = one.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    number = math.ceil((size["n"] or 0) * 24 * max(1, size["width"] or 0) / GROUP_BYTES)  # whole numbers, doubles and their copy
    made = []
    for group in range(number):
        held = one.filter(F.pmod(F.xxhash64("vec_id"), F.lit(number)) == group).orderBy("vec_id").toArrow()
        if held.num_rows:
            made.append(stored(_group(spark, vectors, held, k), "topk"))
    if not made:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = made[0]
    for other in made[1:]:
        out = out.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _group(spark, vectors: DataFrame, held: pa.Table, k: int) -> DataFrame:
    queries = _side(held.to_batches())
    width = queries.rows.shape[1]
    sent = spark.sparkContext.broadcast((queries.ids, queries.rows))  # GROUP_BYTES, about

    def blocks():
        ids, rows = sent.value
        return [(a, Side(ids[a : a + QUERY_BLOCK], rows[a : a + QUERY_BLOCK])) for a in range(0, len(ids), QUERY_BLOCK)]

    def best_of(source, find):
        """The task's k best of every query, as one list that is cut back whenever it doubles."""
        parts, held, size, limit = blocks(), [], 0, 1 << 18
        for tile in _tiles(source, width):
            for a, q in parts:
                r, ids, scores = find(a, q, tile)
                if len(r):
                    held.append((r + a, ids, scores))
                    size += len(r)
            if size > limit:
                held = _merged(held, k)
                size = len(held[0][0])
                limit = max(limit, 2 * size)
        for r, ids, scores in _merged(held, k):
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[0][r]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def gather(source):
        yield from best_of(source, lambda a, q, tile: leaders(q, tile, k))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    known = vectors.mapInArrow(gather, "query_id long, vec_id long, score long").withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
    bounds = known.select("query_id", "score").toArrow()  # a number for each query of the group
    cutoff = np.full(len(queries.ids), -MOST - 1, np.int64)
    cutoff[np.searchsorted(queries.ids, np.asarray(bounds.column("query_id"), np.int64))] = np.asarray(bounds.column("score"), np.int64)
    cutoffs = spark.sparkContext.broadcast(cutoff)

    def resolve(source):
        yield from best_of(source, lambda a, q, tile: sufficient(q, cutoffs.value[a : a + QUERY_BLOCK], tile, k)[:3])

    return vectors.mapInArrow(resolve, "query_id long, vec_id long, score long")
