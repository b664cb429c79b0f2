"""Exact Jaccard similarity join on word n-grams, as a metric-space join (operator 4).

Method: the Jaccard distance is a metric.  Each region chooses pivots, every document of the region
gets its exact distance to them and belongs to the Voronoi cell of the nearest one.  If x and y may
link (distance at most e), d(y, p) <= d(y, nearest pivot of y) + 2e for the pivot p nearest to x, so
that triangle-inequality window replicates the boundary documents that x's cell needs.  Cells are
joined in the same way, within a task once they are of bounded size and by Spark before, until a
cell is small enough to be compared whole.  Only components leave a task, never pairs.

Regions: with random pivots alone nearly all distances between texts are 1, so every window would
hold every document.  The first regions therefore come from an exact decomposition of the same
metric: a set is cut into k parts by hash, and two sets that differ in fewer than k elements agree
on a whole part.  k follows from the threshold and the set sizes, so no linked pair is missed; a
region is a connected group of sets that share parts.  In a region, a set of which too many elements
occur in no other set there can't link and leaves it.  A region whose windows hold nearly all of it
(distances too alike for pivots to tell apart) is cut into blocks, each two of which meet in a task;
blocks of documents in the ball of one pivot, linked through it already, needn't meet.

Documents with equal sets are one class from the start and are never paired.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash_free, drop_stored, parts, stored, text_bytes, words_of
from .components import components

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_WORD_CACHE = 300_000
#: Sets and elements of a region that one task joins; larger regions are split first.
MOST_SETS, MOST_ELEMENTS = 4096, 2_000_000
#: Pivots of a larger region in each round, and its sets in one task while distances are measured.
PIVOTS, PLACED = 8, 2048
#: Part hashes a task holds before it sends them on, and about as many meet in a task.
BATCH_PARTS, BUCKET_PARTS = 3_000_000, 2_000_000
#: Most bits of a filter of ids (broadcast, 4 MB of bits); fuller, it only passes more.
MOST_FILTER_BITS = 1 << 25


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; all words as one if there are fewer."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return np.asarray([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    total = h[: len(h) - size + 1] * _M1
    for i in range(1, size):
        total = mix(total) + h[i : len(h) - size + 1 + i] * _M2
    out = np.sort(mix(total ^ _M3))
    keep = np.empty(len(out), bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


@lru_cache(maxsize=8)
def size_classes(percent: int) -> list[tuple[int, int, int]]:
    """(least size, parts, parts that must agree) of each class; linked sets are in the same or the next class.

    More parts than elements may differ in agree, so that the agreeing ones can't all be empty for
    nearly every set.  Where sets are too small for that, parts are 0: see :func:`part_hashes`.
    """
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(bounds[-1] * 100 // percent + 1)
    out = []
    for low, high in zip(bounds, bounds[1:]):
        most = (high - 1) + (high - 1) * 100 // percent
        apart = most * (100 - percent) // (100 + percent)
        agree = 1
        while apart + agree <= 1.2 * low:
            k = apart + agree
            load = low / k
            empty = k * math.exp(-load)
            spread = math.sqrt(max(0.0, k * (math.exp(-load) - (1 + load) * math.exp(-2 * load))))
            wanted = math.ceil(empty + 4 * spread + 1)
            if wanted <= agree:
                break
            agree = wanted
        else:
            agree = 0
        out.append((low, apart + agree if agree else 0, agree))
    return out


def class_of(n: int, percent: int) -> int:
    bounds = _bounds(percent)
    return int(np.searchsorted(bounds, n, side="right")) - 1


@lru_cache(maxsize=8)
def _bounds(percent: int) -> np.ndarray:
    return np.asarray([c[0] for c in size_classes(percent)], np.int64)


def part_hashes(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which any two linked sets share one, in the set's own size class and the one below.

    A hash for each non-empty part; empty parts count too if a set has so many that no other part
    must agree.  Small sets use single elements instead: two linked sets share one among the
    lowest n - ceil(threshold * n) + 1 of each.
    """
    n = len(s)
    own = class_of(n, percent)
    classes = size_classes(percent)
    found = []
    for c in (own, own - 1):
        if c < 0:
            continue
        _, k, agree = classes[c]
        tag = mix(np.full(1, c, np.uint64) * _M3)
        if not k:
            found.append(mix(s[: n + (-n * percent) // 100 + 1] + tag))
            continue
        part = (s >> np.uint64(20)) % np.uint64(k)
        order = np.argsort(part.astype(np.uint16 if k < 65536 else np.uint32), kind="stable")
        count = np.bincount(part.astype(np.int64), minlength=k)
        full = np.flatnonzero(count)
        starts = np.cumsum(count)[full] - count[full]
        sums = np.add.reduceat(s[order], starts)
        h = mix(sums + mix(count[full].astype(np.uint64) + full.astype(np.uint64) * _M1 + tag))
        if k - len(full) >= agree:
            h = np.concatenate([h, mix(mix(np.flatnonzero(count == 0).astype(np.uint64) * _M1 + tag))])
        found.append(h)
    return np.concatenate(found)


def _sketch_of(text, size: int, percent: int):
    s = shingles(text, size)
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return s, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _stars(parts: np.ndarray, nodes: np.ndarray):
    """Of (part, node) entries: the distinct parts with one node each, and links of that node to the part's other nodes."""
    order = np.argsort(parts)
    p, v = parts[order], nodes[order]
    new = np.empty(len(p), bool)
    new[:1] = True
    np.not_equal(p[1:], p[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    head = v[starts][np.cumsum(new) - 1]
    apart = v != head
    edges = np.unique(np.stack([np.minimum(v, head)[apart], np.maximum(v, head)[apart]], 1), axis=0) if apart.any() else np.empty((0, 2), np.int64)
    return p[starts], v[starts], edges


_PACKED = "bucket int, kind int, x binary, y binary, z binary, w binary"


def _packed(bucket: int, kind: int, *arrays) -> pa.RecordBatch:
    cells = [pa.array([a.tobytes() if a is not None else None], pa.binary()) for a in (*arrays, *[None] * (4 - len(arrays)))]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *cells], names=["bucket", "kind", "x", "y", "z", "w"])


def _documents_and_candidates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of two kinds from one pass over the texts.

    kind 0: a = doc, b = set size, c and d = 128-bit hash of the set.  kind 1: a, b = the c of two
    different sets that share a part.  Sets that share a part are linked to one of them only, first
    in each task and then per part, so neither a part that very many sets hold nor copies of one
    set send more than one entry a task through the shuffle.
    """
    spark = docs.sparkSession
    per_char = 2 * max(k / low if k else 1 - percent / 100 for low, k, _ in size_classes(percent)[8:]) / 6
    buckets = max(parts(spark), math.ceil(text_bytes(docs, "text") * per_char / BUCKET_PARTS))

    def flush(found, nodes):
        lengths = [len(p) for p in found]
        if not sum(lengths):
            return
        p, v, edges = _stars(np.concatenate(found), np.repeat(np.asarray(nodes, np.int64), lengths))
        if len(edges):
            yield _packed(int(edges[0, 0] % buckets), 2, edges[:, 0], edges[:, 1])
        of = ((p >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with p
        cuts = np.searchsorted(of, np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            here = slice(cuts[i], cuts[i + 1])
            table, at = np.unique(v[here], return_inverse=True)
            yield _packed(int(i), 1, p[here], table, at.astype(np.uint32 if len(table) > 65536 else np.uint16))

    def spread(source):
        found, nodes, held = [], [], 0
        for b in source:
            n, h1, h2 = [], [], []
            for t in b.column(1).to_pylist():
                s, x, y = _sketch_of(t, size, percent)
                n.append(len(s))
                h1.append(x)
                h2.append(y)
                if len(s):
                    found.append(part_hashes(s, percent))
                    nodes.append(x)
                    held += len(found[-1])
                    if held >= BATCH_PARTS:
                        yield from flush(found, nodes)
                        found, nodes, held = [], [], 0
            if n:
                yield _packed(h1[0] % buckets, 0, np.asarray(b.column(0)), np.asarray(n, np.int64), np.asarray(h1, np.int64), np.asarray(h2, np.int64))
        yield from flush(found, nodes)

    def rows(kind, *columns):
        k = pa.array(np.full(len(columns[0]), kind, np.int32))
        return pa.RecordBatch.from_arrays([k, *(pa.array(c) for c in columns)], names=["kind", "a", "b", "c", "d"])

    def meet(held):
        if held:
            _, _, edges = _stars(np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held]))
            if len(edges):
                zero = np.zeros(len(edges), np.int64)
                yield rows(1, edges[:, 0], edges[:, 1], zero, zero)

    def gather(source):
        bucket, held = None, []
        for b in source:
            for r in b.to_pylist():
                x, y, z, w = (np.frombuffer(r[c], np.int64) if r[c] is not None and c != "z" else None for c in "xyzw")
                if r["kind"] == 0:
                    yield rows(0, x, y, np.frombuffer(r["z"], np.int64), w)
                elif r["kind"] == 2:
                    zero = np.zeros(len(x), np.int64)
                    yield rows(1, x, y, zero, zero)
                else:
                    if r["bucket"] != bucket:
                        yield from meet(held)
                        bucket, held = r["bucket"], []
                    at = np.frombuffer(r["z"], np.uint16 if len(r["z"]) == 2 * len(x) else np.uint32)
                    held.append((x.view(np.uint64), y[at]))
        yield from meet(held)

    dealt = docs.mapInArrow(spread, _PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(gather, "kind int, a long, b long, c long, d long"), "seen")


class _Cells:
    """Exact join of the sets of one region inside a task: Voronoi cells around pivots, windows, recursion.

    ``root`` becomes the component of each set.  Nothing leaves the task but that.
    """

    def __init__(self, sets, percent: int, leaf: int = 256, pivots: int = 8):
        self.percent, self.leaf, self.pivots, self.e = percent, leaf, pivots, 1 - percent / 100
        self.n = np.asarray([len(s) for s in sets], np.int64)
        self.root = np.arange(len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.n)
        alive = np.ones(len(sets), bool)
        while True:  # an element that no other set holds is in no intersection
            _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
            shared = df[code] > 1
            flat, owner, code = flat[shared], owner[shared], code[shared]
            ok = 100 * np.bincount(owner, minlength=len(sets)) >= percent * self.n
            if not (alive & ~ok).any():
                break
            alive &= ok
            here = alive[owner]
            flat, owner = flat[here], owner[here]
        _, self.code = np.unique(code, return_inverse=True)
        self.codes = int(self.code.max()) + 1 if len(code) else 0
        self.start = np.searchsorted(owner, np.arange(len(sets) + 1))
        ids = np.flatnonzero(alive)
        if len(ids) > 1:
            self._join(ids)

    def _take(self, ids):
        lengths = self.start[ids + 1] - self.start[ids]
        at = np.repeat(self.start[ids] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return self.code[at], np.repeat(np.arange(len(ids)), lengths)

    def _linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def _union(self, ids, labels):
        """Sets of one label become one component."""
        roots = self.root[ids]
        order = np.argsort(labels, kind="stable")
        labels, roots = labels[order], roots[order]
        first = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        for low, high in zip(first, [*first[1:], len(labels)]):
            found = np.unique(roots[low:high])
            if len(found) > 1:
                target = found[0]
                self.root[np.isin(self.root, found)] = target

    def _join(self, ids):
        if len(np.unique(self.root[ids])) == 1:
            return
        if len(ids) <= self.leaf:
            self._brute(ids)
            return
        code, owner = self._take(ids)
        n = self.n[ids]
        far, apart, pivot = np.full(len(ids), np.inf), [], 0
        mask = np.zeros(self.codes, bool)
        for _ in range(self.pivots):
            mine = code[owner == pivot]
            mask[mine] = True
            both = np.bincount(owner[mask[code]], minlength=len(ids))
            mask[mine] = False
            hit = self._linked(both, n, n[pivot])
            self._union(ids[hit], np.zeros(hit.sum(), np.int64))
            d = 1 - both / (n + n[pivot] - both)
            apart.append(d)
            far = np.minimum(far, d)
            pivot = int(far.argmax())
            if far[pivot] == 0:
                break
        d = np.stack(apart, 1)
        within = d <= d.min(1)[:, None] + 2 * self.e + 1e-9
        home = d.argmin(1)
        if within.sum(0).max() > 0.75 * len(ids):
            self._brute(ids)
            return
        for c in range(d.shape[1]):
            if (home == c).any():
                self._join(ids[within[:, c]])

    def _brute(self, ids):
        """Intersection sizes of all sets of a cell: frequent elements by matrix products, others by their lists."""
        m = len(ids)
        code, owner = self._take(ids)
        _, code, df = np.unique(code, return_inverse=True, return_counts=True)
        both = np.zeros((m, m), np.float32)
        often = np.flatnonzero(df > max(8, m // 16))
        rank = np.full(len(df), -1)
        rank[often] = np.arange(len(often))
        at = rank[code]
        step = max(64, (8 << 20) // m)
        for low in range(0, len(often), step):
            some = (at >= low) & (at < low + step)
            block = np.zeros((m, min(step, len(often) - low)), np.float32)
            block[owner[some], at[some] - low] = 1
            both += block @ block.T
        rare = (at < 0) & (df[code] > 1)
        if rare.any():
            o, c = owner[rare], code[rare]
            order = np.argsort(c, kind="stable")
            o, c = o[order], c[order]
            ends = np.flatnonzero(np.concatenate([c[1:] != c[:-1], [True]]))
            begins = np.concatenate([[0], ends[:-1] + 1])
            span = np.repeat(ends - begins + 1, ends - begins + 1)
            begin = np.repeat(begins, ends - begins + 1)
            for low in range(0, len(o), max(1, (4 << 20) // max(8, m // 16))):
                some = slice(low, low + max(1, (4 << 20) // max(8, m // 16)))
                s = span[some]
                x = np.repeat(o[some], s)
                y = o[np.repeat(begin[some] - (np.cumsum(s) - s), s) + np.arange(s.sum())]
                np.add.at(both, (x, y), 1) if m > 2048 else both.__iadd__(np.bincount(x * m + y, minlength=m * m).reshape(m, m).astype(np.float32))
        n = self.n[ids].astype(np.float64)
        linked = np.concatenate([(100.0 + self.percent) * both[i : i + 256] >= self.percent * (n[i : i + 256, None] + n[None, :]) for i in range(0, m, 256)])
        np.fill_diagonal(linked, True)
        label = np.arange(m, dtype=np.int32)
        while True:
            low = np.concatenate([np.where(linked[i : i + 256], label[None, :], np.int32(m)).min(1) for i in range(0, m, 256)])
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        self._union(ids, label)


def _solved(rows: DataFrame, percent: int, size: int | None = None) -> DataFrame:
    """``doc, label`` of whole regions of bounded size: label is the smallest doc a set reaches by links.

    ``rows`` hold ``region, doc`` and ``s``, or ``text`` if a shingle ``size`` is given.
    """

    def solve(docs, sets):
        found = _Cells(sets, percent).root
        docs = np.asarray(docs, np.int64)
        low = np.full(len(docs), np.iinfo(np.int64).max)
        np.minimum.at(low, found, docs)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(low[found])], names=["doc", "label"])

    def run(source):
        region, docs, sets = None, [], []
        for b in source:
            third = b.column(2).to_pylist() if size else b.column(2)
            for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), third):
                if r != region:
                    if docs:
                        yield solve(docs, sets)
                    region, docs, sets = r, [], []
                docs.append(d)
                sets.append(shingles(t, size) if size else t.values.to_numpy().view(np.uint64))
        if docs:
            yield solve(docs, sets)

    ordered = rows.select("region", "doc", "text" if size else "s").repartition(parts(rows.sparkSession), "region").sortWithinPartitions("region")
    return ordered.mapInArrow(run, "doc long, label long")


def _measured(texts: DataFrame, size: int) -> DataFrame:
    """``region, doc, n, s``: the sets themselves, for regions that no single task can hold."""

    def run(source):
        for b in source:
            sets = [shingles(t, size).view(np.int64) for t in b.column(2).to_pylist()]
            if sets:
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                n = pa.array(np.diff(offsets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["region", "doc", "n", "s"])

    return texts.select("region", "doc", "text").mapInArrow(run, "region long, doc long, n long, s array<long>")


def _peeled(sets: DataFrame, percent: int) -> DataFrame:
    """Without the sets of which too many elements are in no other set of their region."""
    alone = sets.select("region", "doc", F.explode("s").alias("x")).groupBy("region", "x").agg(F.count(F.lit(1)).alias("k"), F.min("doc").alias("doc")).filter("k = 1")
    few = alone.groupBy("region", "doc").agg(F.count(F.lit(1)).alias("alone"))
    return sets.join(few, ["region", "doc"], "left").filter(f"100 * (n - coalesce(alone, 0)) >= {percent} * n").drop("alone")


def _placed(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``region, doc, n, s, cells, core, links``: Voronoi cells whose windows hold a set, and the pivots it links to.

    core is 0, or says which group of linked pivots the set is linked to.  A region is dealt in
    blocks, and each receives the sets of the region's few pivots first.
    """
    draws = [F.min(F.struct(F.xxhash64("doc", F.lit(i)).alias("h"), "doc")) for i in range(PIVOTS)]
    chosen = sets.groupBy("region").agg(F.array_distinct(F.array(*[d["doc"] for d in draws])).alias("p")).select("region", F.explode("p").alias("doc"))
    blocks = F.ceil(F.col("m") / PLACED).cast("int")
    pivots = sets.join(chosen, ["region", "doc"], "left_semi").join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(0).alias("role"), "doc", "n", "s")
    members = sets.join(sizes, "region").select("region", F.pmod(F.xxhash64("doc"), blocks).cast("int").alias("block"), F.lit(1).alias("role"), "doc", "n", "s")
    e = 1 - percent / 100

    def run(source):
        at, ids, held, group = None, [], [], []
        for b in source:
            out = []
            for r, k, role, doc, s in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(5)):
                s = s.values.to_numpy().view(np.uint64)
                if (r, k) != at:
                    at, ids, held, group = (r, k), [], [], []
                if role == 0:
                    same = [i for i, o in enumerate(held) if _links(o, s, percent)[0]]
                    new = min([group[i] for i in same], default=len(held))
                    group = [new if g in {group[i] for i in same} else g for g in group] + [new]
                    ids.append(doc)
                    held.append(s)
                    out.append(None)
                    continue
                met = [_links(o, s, percent) for o in held]
                near = min(d for _, d in met)
                hits = [i for i, (hit, _) in enumerate(met) if hit]
                out.append(([i for i, (_, d) in enumerate(met) if d <= near + 2 * e + 1e-9], 1 + group[min(hits, key=lambda i: met[i][1])] if hits else 0, [ids[i] for i in hits]))
            keep = [i for i, o in enumerate(out) if o is not None]
            if keep:
                kept = b.take(pa.array(keep))
                cells, core, links = zip(*(out[i] for i in keep))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), kept.column(4), kept.column(5), pa.array(cells, pa.list_(pa.int32())), pa.array(core, pa.int32()), pa.array(links, pa.list_(pa.int64()))], names=["region", "doc", "n", "s", "cells", "core", "links"])

    dealt = pivots.unionByName(members).repartition(parts(sets.sparkSession), "region", "block").sortWithinPartitions("region", "block", "role", "doc")
    return dealt.mapInArrow(run, "region long, doc long, n long, s array<long>, cells array<int>, core int, links array<long>")


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether two sorted sets link, and their distance."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    either = len(a) + len(b) - both
    return 100 * both >= percent * either, 1 - both / either


def _sized(sets: DataFrame) -> DataFrame:
    return sets.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))


def _is_large():
    return (F.col("m") > MOST_SETS) | ((F.col("total") > MOST_ELEMENTS) & (F.col("m") > 32))


def _large_links(sets: DataFrame, percent: int) -> DataFrame | None:
    """``a, b``: links that connect all linked sets of large regions."""
    found, now = [], sets
    while True:
        left = stored(_peeled(now, percent), "peeled")
        drop_stored(now)
        sizes = stored(_sized(left), "sizes")
        small = left.join(sizes.filter(~_is_large()), "region").select("region", "doc", "s")
        found.append(stored(_solved(small, percent).filter("doc <> label").select(F.col("doc").alias("a"), F.col("label").alias("b")), "links"))
        large = sizes.filter(_is_large())
        if large.isEmpty():
            drop_stored(left)
            drop_stored(sizes)
            return found
        placed = stored(_placed(left.join(large.select("region"), "region", "left_semi"), large, percent), "placed")
        drop_stored(left)
        found.append(stored(placed.select(F.col("doc").alias("a"), F.explode("links").alias("b")).filter("a <> b"), "links"))
        each = placed.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count(F.lit(1)).alias("k"))
        dense = stored(each.groupBy("region").agg(F.max("k").alias("most"), F.sum("k").alias("all")).join(large, "region").select("region", F.expr("most > 0.75 * m or all > 2 * m").alias("dense")), "dense")
        meeting = _met_blocks(placed.join(dense.filter("dense"), "region", "left_semi"))
        found.append(stored(_solved(meeting, percent).filter("doc <> label").select(F.col("doc").alias("a"), F.col("label").alias("b")), "links"))
        cells = placed.join(dense.filter("not dense"), "region", "left_semi").select(F.explode("cells").alias("cell"), "region", "doc", "n", "s")
        now = stored(cells.select(F.xxhash64("region", "cell").alias("region"), "doc", "n", "s"), "cells")
        for used in (placed, sizes, dense):
            drop_stored(used)


def _met_blocks(placed: DataFrame) -> DataFrame:
    """``region, doc, s``: each set in a task with each other block it may have an unknown link to."""
    of = placed.groupBy("region", "core").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).withColumn("b", F.greatest(F.ceil(F.col("k") * 2 / MOST_SETS), F.ceil(F.col("total") * 2 / MOST_ELEMENTS)).cast("int"))
    lists = of.groupBy("region").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.struct(F.col("core").alias("core"), i.alias("i"))))).alias("blocks"))
    own = placed.join(of.select("region", "core", "b"), ["region", "core"]).join(lists, "region")
    own = own.withColumn("own", F.struct("core", F.pmod(F.xxhash64("doc"), F.col("b")).cast("int").alias("i")))
    others = F.filter("blocks", lambda x: (x["core"] != F.col("core")) | (x["core"] == 0))
    return own.withColumn("other", F.explode(others)).select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "doc", "s")


def _bits(values: DataFrame) -> tuple[DataFrame, int]:
    """Bitmap of a column ``v`` of hashes as ``w, bits`` rows, at most MOST_FILTER_BITS / 64 of them, and its size."""
    bits, count = 1 << 16, values.count()
    while bits < min(MOST_FILTER_BITS, 16 * count):
        bits *= 2
    at = F.col("v").bitwiseAND(F.lit(bits - 1))
    return values.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("bits")), bits


def _maybe(df: DataFrame, hashed, flag: str, values: DataFrame) -> DataFrame:
    """``df`` with a column ``flag``: false only if the hash is surely not among ``values``."""
    made, bits = _bits(values)
    p = clash_free(df, flag)
    made = made.select(F.col("w").alias(p + "w"), F.col("bits").alias(p + "bits"))
    held = df.withColumn(p + "v", hashed).join(F.broadcast(made), F.shiftright(F.col(p + "v").bitwiseAND(F.lit(bits - 1)), 6) == F.col(p + "w"), "left")
    return held.withColumn(flag, F.coalesce(F.getbit(p + "bits", F.col(p + "v").bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))).drop(p + "v", p + "w", p + "bits")


def similar_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """``doc, n_shingles, class_id, component`` for every row of ``df``.

    ``class_id`` is the smallest id with the same set; ``component`` the smallest id reachable by
    links of ``100 * both >= percent * either``.  Sets without shingles (null, empty or blank
    texts) link with nothing, so they are their own component.  Rows that repeat an id are one
    document each row of which is reported; should their texts differ, each row keeps its own set,
    links of all its texts count, and all of them share the id's component.  A null id is treated
    as the smallest id.
    """
    docs = df.select(_own_id(id_column).alias("doc"), F.col(text_column).alias("text"))
    if not _repeats(docs):
        return _groups(docs, size, percent)
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = stored(_groups(numbered.select(F.col("row").alias("doc"), "text"), size, percent).withColumnRenamed("doc", "row").join(numbered.select("row", "doc"), "row"), "row-groups")
    classes = found.groupBy("class_id").agg(F.min("doc").alias("class_doc"))
    low = found.groupBy("component").agg(F.min("doc").alias("low"))
    edges = found.join(low, "component").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct()
    ids = components(edges)
    out = found.drop("component").join(classes, "class_id").join(ids, F.col("doc") == F.col("node"), "left")
    return out.select("doc", "n_shingles", F.col("class_doc").alias("class_id"), F.coalesce("component", "doc").alias("component"))


def _own_id(id_column: str):
    return F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).isEmpty()


def _groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """:func:`similar_groups` of ``doc, text`` where no ``doc`` repeats."""
    seen = _documents_and_candidates(docs, size, percent)
    rows = seen.filter("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("h1"), F.col("d").alias("h2"))
    classes = stored(rows.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("class_id"), F.min("n").alias("n")), "classes")
    regions = components(seen.filter("kind = 1").select("a", "b"))
    members = stored(classes.join(regions, F.col("h1") == F.col("node")).select(F.col("component").alias("region"), F.col("class_id").alias("doc"), "n"), "members")
    drop_stored(regions)
    labels = _labels(docs, members, size, percent)
    groups = classes.join(labels, F.col("class_id") == F.col("node"), "left").select("h1", "h2", "class_id", F.coalesce("label", "class_id").alias("component"))
    out = rows.join(groups, ["h1", "h2"], "left")
    return out.select("doc", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("class_id")), F.col("doc")).alias("class_id"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc")).alias("component"))


def _labels(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``node, label`` of the classes that are not the smallest of their component."""
    sized = stored(members.join(_sized(members), "region").withColumn("large", _is_large()).select("region", "doc", "large"), "regions")
    drop_stored(members)
    held = _maybe(docs, F.xxhash64("doc"), "maybe", sized.select(F.xxhash64("doc").alias("v"))).filter("maybe").drop("maybe")
    texts = held.join(sized, "doc")
    some_large = not sized.filter("large").limit(1).isEmpty()
    if some_large:
        texts = stored(texts, "texts")
    labels = stored(_solved(texts.filter("not large"), percent, size).filter("doc <> label").select(F.col("doc").alias("node"), "label"), "labels")
    if some_large:
        links = _large_links(stored(_measured(texts.filter("large"), size), "measured"), percent)
        drop_stored(texts)
        edges = links[0]
        for more in links[1:]:
            edges = edges.unionByName(more)
        found = components(edges)
        for used in links:
            drop_stored(used)
        labels = labels.unionByName(found.filter("node <> component").select("node", F.col("component").alias("label")))
    drop_stored(sized)
    return labels


def keep_one_per_group(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document (the smallest id) of each group of near duplicates; all columns stay.

    Rows are judged one by one, also those that share an id or have none; of rows that are equal in
    all columns one is kept.
    """
    docs = df.select(_own_id(id_column).alias("doc"), F.col(text_column).alias("text"))
    if not _repeats(docs):
        gone = stored(_groups(docs, size, percent).filter("doc <> component").select("doc"), "gone")
        return _without(df, _own_id(id_column), gone)
    row = clash_free(df) + "row"
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _groups(numbered.select(F.col(row).alias("doc"), F.col(text_column).alias("text")), size, percent)
    ranked = numbered.select(F.col(row).alias("doc"), F.struct(_own_id(id_column).alias("id"), F.xxhash64(text_column).alias("h"), F.col(row).alias("row")).alias("rank"))
    kept = stored(found.join(ranked, "doc").groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(row)), "groups")
    return numbered.join(kept, row, "left_semi").drop(row).dropDuplicates()


def _without(df: DataFrame, own_id, gone: DataFrame) -> DataFrame:
    """``df`` without the ids in ``gone``; rows that a filter clears are not shuffled."""
    flag = clash_free(df) + "maybe"
    judged = _maybe(df, F.xxhash64(own_id), flag, gone.select(F.xxhash64("doc").alias("v")))
    doubt = judged.filter(F.col(flag)).drop(flag).withColumn(flag, own_id)
    kept = doubt.join(gone.select(F.col("doc").alias(flag)), flag, "left_anti").drop(flag)
    return judged.filter(~F.col(flag)).drop(flag).unionByName(kept)
