"""Rolled 2-bit k-mer codes of whole Arrow batches (W01, F01, F03, F05): two bits a base, base i at bits 2i.

Up to k = 31 a code is a long.  From 32 to 63 it is two: bases 32 and on in ``high``, the first 32 in
``low``, whose top bit is turned over, so that the order of signed pairs is the codes' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MOST_K = 31
#: With two longs.
MOST_LONG_K = 63
_TOP = np.uint64(1 << 63)
#: Starts worked on at once, so that arrays stay in a core's cache.
STEP = 1 << 18

_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_REVERSED_BYTE = np.asarray([int(f"{m:08b}"[::-1], 2) for m in range(256)], np.uint8)


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin and end in them; a null row is empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def valid_starts(letters: np.ndarray, bounds: np.ndarray, k: int, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and place of each start of k bases ACGT in one row, some at a time, in order."""
    ends = bounds[1:]
    for low in range(0, max(0, len(letters) - k + 1), step):
        piece = letters[low : low + step + k - 1]
        bad = np.concatenate(([0], np.cumsum(_BASE[piece] > 3)))
        at = np.flatnonzero(bad[k:] == bad[: len(bad) - k]) + low
        row = np.searchsorted(ends, at, side="right")
        inside = at + k <= ends[row]
        yield row[inside], at[inside]


def rolled(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of k bases and of their reverse complements, by doubling."""
    size, one, two = 1, bases.astype(np.uint64), (3 - bases.astype(np.int64)).astype(np.uint64) & np.uint64(3)
    done, forward, reverse = 0, None, None
    while True:
        if k & size:
            if forward is None:
                forward, reverse = one, two
            else:
                n = min(len(forward), len(one) - done)
                forward = forward[:n] | (one[done : done + n] << np.uint64(2 * done))
                reverse = (reverse[:n] << np.uint64(2 * size)) | two[done : done + n]
            done += size
            if done == k:
                return forward, reverse
        one, two = one[:-size] | (one[size:] << np.uint64(2 * size)), (two[:-size] << np.uint64(2 * size)) | two[size:]
        size *= 2


def canonical_codes(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, place in its text, canonical code and whether it is the reverse complement's, of each valid k-mer."""
    letters, bounds = letters_of(texts)
    for row, at in valid_starts(letters, bounds, k):
        if len(at):
            forward, reverse = rolled(_BASE[letters[at[0] : at[-1] + k]] & 3, k)
            forward, reverse = forward[at - at[0]], reverse[at - at[0]]
            yield row, at - bounds[row], np.minimum(forward, reverse).view(np.int64), reverse < forward


def _strands(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """High and low longs of each window of k bases (32 to 63), those of its reverse complement, and whether the latter is less."""
    forward, reverse = rolled(bases, 32)
    n = len(bases) - k + 1
    low, turned_low = forward[:n], reverse[k - 32 : k - 32 + n]
    if k > 32:
        above, below = rolled(bases, k - 32)
        high, turned_high = above[32 : 32 + n], below[:n]
    else:
        high = turned_high = np.zeros(n, np.uint64)
    less = (turned_high < high) | ((turned_high == high) & (turned_low < low))
    return high, low, turned_high, turned_low, less


def _canonical_pair(strands, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high, low, turned_high, turned_low, less = (x[at] for x in strands)
    return np.where(less, turned_high, high).view(np.int64), (np.where(less, turned_low, low) ^ _TOP).view(np.int64), less


def canonical_pairs(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`canonical_codes` for k of 32 to 63: row, place, high and low long, and whether it is the reverse complement's."""
    letters, bounds = letters_of(texts)
    for row, at in valid_starts(letters, bounds, k):
        if len(at):
            high, low, turned = _canonical_pair(_strands(_BASE[letters[at[0] : at[-1] + k]] & 3, k), at - at[0])
            yield row, at - bounds[row], high, low, turned


def _masks(letters: np.ndarray, bounds: np.ndarray, row: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Bits of the bases beside each k-mer, within its row."""
    bit = np.asarray([8, 4, 2, 1, 0], np.uint8)
    left = np.where(at > bounds[row], bit[_BASE[letters[at - 1]]], 0).astype(np.uint8) << 4
    right = np.where(at + k < bounds[row + 1], bit[_BASE[letters[np.minimum(at + k, len(letters) - 1)]]], 0).astype(np.uint8)
    return left | right


def neighbour_pair_masks(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`neighbour_masks` for k of 32 to 63: high and low long, and the overlap mask."""
    letters, bounds = letters_of(texts)
    for row, at in valid_starts(letters, bounds, k):
        if len(at):
            high, low, turned = _canonical_pair(_strands(_BASE[letters[at[0] : at[-1] + k]] & 3, k), at - at[0])
            mask = _masks(letters, bounds, row, at, k)
            yield high, low, np.where(turned, _REVERSED_BYTE[mask], mask)


def neighbour_masks(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Canonical code and overlap mask (bits of the valid k-mers before and after it) of each valid k-mer."""
    letters, bounds = letters_of(texts)
    for row, at in valid_starts(letters, bounds, k):
        if not len(at):
            continue
        forward, reverse = rolled(_BASE[letters[at[0] : at[-1] + k]] & 3, k)
        forward, reverse = forward[at - at[0]], reverse[at - at[0]]
        mask = _masks(letters, bounds, row, at, k)
        yield np.minimum(forward, reverse).view(np.int64), np.where(reverse < forward, _REVERSED_BYTE[mask], mask)


def substrings(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Row, place and letters of each valid k-mer, for any k."""
    letters, bounds = letters_of(texts)
    if len(letters) < k:
        return
    cut = np.lib.stride_tricks.sliding_window_view(letters, k)
    for row, at in valid_starts(letters, bounds, k, max(1024, STEP // 4)):
        if len(at):
            text = np.ascontiguousarray(cut[at])
            offsets = np.arange(len(at) + 1, dtype=np.int32) * np.int32(k)
            yield row, at - bounds[row], pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(text))


#: Bases of a long, and of a super-k-mer at most: two longs, or four for k above 31.
WORD = 32


def super_words(k: int) -> int:
    return 2 if k <= MOST_K else 4


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values, by doubling."""
    size, out, done = 1, None, 0
    while True:
        if width & size:
            n = len(values) - done
            out = values if out is None else np.minimum(out[:n], values[done : done + len(out[:n])])
            done += size
            if done == width:
                return out
        values = np.minimum(values[:-size], values[size:])
        size *= 2


def mixed(code: np.ndarray) -> np.ndarray:
    """Codes in an order of their own, so that runs of one base aren't the least; 32 bits."""
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def super_kmers(texts: pa.Array, k: int, m: int, beside: bool = False) -> Iterator[list[np.ndarray]]:
    """Minimizer, bases as codes of 32 each (:func:`super_words` of them), and number of k-mers of each run of valid k-mers with one minimizer.

    A k-mer's minimizer is the least of its m-mers, each taken from whichever strand is less, so both
    strands of a k-mer have the same.  With ``beside``, before the number: the bases beside the run in
    its row, 8 times the left one's number and the right one's; 4 where there is none.
    """
    letters, bounds = letters_of(texts)
    words = super_words(k)
    for row, at in valid_starts(letters, bounds, k):
        if not len(at):
            continue
        low = at[0]
        bases = _BASE[letters[low : at[-1] + k]] & 3
        forward, reverse = rolled(bases, m)
        least = _least(mixed(np.minimum(forward, reverse)), k - m + 1)[at - low]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (least[1:] != least[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - first) % (words * WORD - k + 1) == 0
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(at)))
        packed = rolled(np.concatenate([bases, np.zeros((words + 1) * WORD, bases.dtype)]), WORD)[0]
        size, place = count + k - 1, at[starts] - low
        kept = lambda code, n: np.where(n >= WORD, code, code & ((np.uint64(1) << (2 * np.clip(n, 0, WORD - 1)).astype(np.uint64)) - np.uint64(1)))
        around = []
        if beside:
            first, after, own = at[starts], at[starts] + size, row[starts]
            left = np.where(first > bounds[own], _BASE[letters[first - 1]], 4)
            right = np.where(after < bounds[own + 1], _BASE[letters[np.minimum(after, len(letters) - 1)]], 4)
            around = [left.astype(np.int64) * 8 + right]
        yield [least[starts].view(np.int64), *(kept(packed[place + WORD * w], size - WORD * w).view(np.int64) for w in range(words)), *around, count]
