"""Shortest lengths along a graph's arcs, for blocks of sources at once.

The graph is arrays: nodes by number, the arcs of each node one after the other.  A block's search keeps a length for
every pair of one of its sources and one of the nodes within its reach, so blocks are as large as such pairs are few.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

#: Pairs of a source and a node that a block holds lengths of.
CELLS = 1 << 21
#: Rows given out at once.
ROWS = 1 << 16


class Steps:
    """``ids`` of the nodes in order, ``first`` arc of each (and the end), node number entered and length of each arc."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        begin = np.searchsorted(self.ids, src)
        order = np.argsort(begin, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(begin, minlength=len(self.ids)))])
        self.after = np.searchsorted(self.ids, dst)[order].astype(np.int32)
        self.cost = cost[order].astype(np.min_scalar_type(int(cost.max(initial=0))))  # short numbers are sorted faster


def _arcs(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each arc of ``nodes``, its place in ``nodes`` and its number."""
    low = first[nodes]
    count = first[nodes + 1] - low
    whose = np.repeat(np.arange(len(nodes)), count)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(count) - count - low, count)


def _settle(first: np.ndarray, after: np.ndarray, cost: np.ndarray, row: np.ndarray, node: np.ndarray, at: np.ndarray, size: int, max_len: int) -> Iterator[np.ndarray]:
    """Lengths of the paths from ``node`` of each ``row``, put into ``at`` (``row * size + node``; -1 where there is none); yields the pairs as they are settled, by length."""
    due: dict[int, list[np.ndarray]] = defaultdict(list)
    lengths: list[int] = []

    def go_on(base: np.ndarray, nodes: np.ndarray, done: int) -> None:
        whose, arc = _arcs(first, nodes)
        cell, step = base[whose] + after[arc], cost[arc]
        open_ = at[cell] < 0
        cell, step = cell[open_], step[open_]
        order = np.argsort(step, kind="stable")
        cell, step = cell[order], step[order]
        cuts = np.flatnonzero(np.diff(step)) + 1
        for piece, value in zip(np.split(cell, cuts), step[np.concatenate([[0], cuts])] if len(step) else ()):
            length = done + int(value)
            if length > max_len:
                break
            if length not in due:
                heappush(lengths, length)
            due[length].append(piece)

    go_on(row * size, node, 0)
    while lengths:
        length = heappop(lengths)
        cell = np.concatenate(due.pop(length))
        cell = cell[at[cell] < 0]
        place = np.arange(len(cell))
        at[cell] = place  # of equal ones, the last stays
        cell = cell[at[cell] == place]
        at[cell] = length
        if len(cell):
            yield cell
            nodes = cell % size
            go_on(cell - nodes, nodes, length)


def _near(steps: Steps, block: np.ndarray, at: np.ndarray, max_len: int) -> np.ndarray:
    """Nodes that any of the block reaches, and its own; ``at`` is -1 throughout, before and after."""
    found = list(_settle(steps.first, steps.after, steps.cost, np.zeros(len(block), np.int64), block, at, len(at), max_len))
    reached = np.concatenate([*found, block])
    at[reached] = -1
    return np.unique(reached)


def shortest(steps: Steps, sources: np.ndarray, max_len: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of ``sources`` (numbers of nodes, each once): the block, the nodes near it in order, and a table of lengths up to ``max_len``, -1 where there is no path."""
    whole = np.full(len(steps.ids), -1, np.int64)
    low, n = 0, max(1, CELLS // max(1, len(steps.ids)))
    while low < len(sources):
        block = sources[low : low + n]
        near = _near(steps, block, whole, max_len)
        if len(block) > 1 and len(block) * len(near) > CELLS:
            n = max(1, min(len(block) // 2, CELLS // len(near)))
            continue
        whole[near] = np.arange(len(near))
        whose, arc = _arcs(steps.first, near)
        after, cost = whole[steps.after[arc]], steps.cost[arc]
        whose, after, cost = (x[after >= 0] for x in (whose, after, cost))  # others lead beyond the bound
        first = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(near)))])
        at = np.full(len(block) * len(near), -1, np.int64)
        for _ in _settle(first, after, cost, np.arange(len(block)), whole[block], at, len(near), max_len):
            pass
        whole[near] = -1
        yield block, near, at.reshape(len(block), len(near))
        low += len(block)
        n = max(n, min(2 * len(block), CELLS // len(near)))
