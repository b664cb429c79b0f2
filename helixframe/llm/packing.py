"""Best-fit packing of tokenised documents into fixed-length sequences (operator 8).

Method: best-fit decreasing, then swap-based local search.  One-for-one and
two-for-one exchanges and moves between underfull bins are taken while they raise
the sum of squared fill, so that bins empty.

Scale: lengths are whole numbers up to the capacity, so the search works on the
histogram of lengths and on bin patterns with multiplicities; its state is bounded
by the capacity.  Pieces find their bin by their rank among pieces of equal length,
which is counted in cells and never gathered in one task or on the driver.
"""

from __future__ import annotations

import bisect
import json
import re
from array import array
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import clash_free, stored

CAPACITY = 2048
#: Exchanges that the local search may take, at any size of the input; each serves as many bins as share both patterns.
SEARCH_STEPS = 4000
CACHE_ITEMS = 800_000
ROWS_PER_CELL = 1_000_000


#: Separators that pattern engines class unlike each other; texts with them go to the library whole.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
# The pre-tokenizer pattern of byte-level BPE, and the same for ASCII texts.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ASCII_PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


def _rank_encoder(spec: str):
    """A faster library's encoder of single pre-tokens from the same vocabulary file.

    It takes ids for merge ranks, so it is used only where the file's ids are in the order of its
    merges; otherwise (None) the tokenizers library encodes everything.
    """
    import tiktoken

    model = json.loads(spec)["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class _Pieces(dict):
    """ids of each pre-token, as little-endian unsigned 32-bit numbers, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("I", self.encode(piece)).tobytes()
        return found


class BulkTokenizer:
    """ids of whole texts by the tokenizers library's vocabulary, each distinct pre-token encoded once."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        fast = _rank_encoder(spec)
        self.cache = _Pieces(self._encode if fast is None else lambda p: fast(p.encode("utf-8", "replace")))

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) > CACHE_ITEMS:
            self.cache.clear()
        ids_of, out = self.cache.__getitem__, []
        for t in texts:
            if _ODD_SPACE.search(t) or any(s in t for s in self.specials):
                out.append(array("I", self._encode(t)).tobytes())
            else:
                out.append(b"".join(map(ids_of, (_ASCII_PRE_TOKEN if t.isascii() else _PRE_TOKEN).findall(t))))
        return out


@lru_cache(maxsize=2)
def bulk_tokenizer(spec: str) -> BulkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return BulkTokenizer(spec)


def pieces(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (ids: little-endian unsigned 32-bit), one row per piece.

    A document's ids end with ``end_id``, so null and empty texts are one piece of one id.  Longer
    documents than ``capacity`` are cut; their first piece takes what full pieces leave.  Repeated
    rows give repeated pieces.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, of fixed size
    end = int(end_id).to_bytes(4, "little")

    def run(source):
        tok = bulk_tokenizer(spec.value)
        for b in source:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc, i, s, e - s, ids[4 * s : 4 * e]) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            if rows:
                doc, piece, start, length, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Counter:
    """Bin patterns (lengths, falling) with their numbers: best fit, longest pieces first."""
    open_bins: dict[int, list] = defaultdict(list)  # room -> [(pattern, number)]
    rooms: list[int] = []
    done: Counter = Counter()

    def put(pattern: tuple, room: int, number: int) -> None:
        if not number:
            return
        if room < 1:
            done[pattern] += number
            return
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append((pattern, number))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                put((length,) * per, capacity - per * length, left // per)
                if left % per:
                    put((length,) * (left % per), capacity - left % per * length, 1)
                break
            room = rooms[at]
            pattern, number = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
            each = min(room // length, left)
            bins = min(number, left // each)
            put(pattern, room, number - bins)
            put(pattern + (length,) * each, room - each * length, bins)
            left -= bins * each
    for room in rooms:
        for pattern, number in open_bins[room]:
            done[pattern] += number
    return done


def improve(bins: Counter, capacity: int, steps: int = SEARCH_STEPS) -> Counter:
    """Local search on patterns: moves, one-for-one and two-for-one exchanges that raise squared fill most.

    The emptiest bins give, fuller ones take; a step is taken for as many pairs of bins as both
    patterns have.  It ends when no exchange helps, at the lower bound, or after ``steps``.
    """
    bins = _sorted(bins)
    floor = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)
    stuck: set = set()
    for _ in range(steps):
        if sum(bins.values()) <= floor:
            break
        under = [p for p in bins if sum(p) < capacity]
        givers = sorted((p for p in under if p not in stuck), key=lambda p: (sum(p), p))
        if not givers:
            break
        giver = givers[0]
        step = _best_step(giver, under, bins, capacity)
        if step is None:
            stuck.add(giver)
            continue
        taker, out, back = step
        number = bins[giver] // 2 if giver == taker else min(bins[giver], bins[taker])
        new_giver, new_taker = _swap(giver, out, back), _swap(taker, back, out)
        for p, n in ((giver, -number), (taker, -number), (new_giver, number), (new_taker, number)):
            if p:
                bins[p] += n
                if not bins[p]:
                    del bins[p]
        stuck.clear()
    return bins


def _sorted(bins: Counter) -> Counter:
    out: Counter = Counter()
    for p, n in bins.items():
        out[tuple(sorted(p, reverse=True))] += n
    return out


def _swap(pattern: tuple, out: tuple, back: tuple) -> tuple:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted([*left, *back], reverse=True))


def _best_step(giver: tuple, under: list[tuple], bins: Counter, capacity: int):
    """The (taker, given pieces, returned pieces) that raises the sum of squares most, or None.

    A taker gains most by the exchange that fills it most, and none gains more than by being filled
    whole, so takers are tried by falling room until no other can gain more.
    """
    fill = sum(giver)
    pieces = Counter(giver)
    ones = sorted(pieces)
    given = {x: (x,) for x in ones}
    for a, x in enumerate(ones):
        for y in ones[a:]:
            if x != y or pieces[x] > 1:
                given.setdefault(x + y, (y, x))
    sums = sorted(given)
    best, gain = None, 0
    for room, taker in sorted(((capacity - sum(t), t) for t in under), reverse=True):
        if 2 * room * (capacity - fill) <= gain:
            break
        if taker == giver and bins[giver] < 2:
            continue
        have, found = capacity - room, (0, None, None)
        if (at := bisect.bisect_right(ones, room)) and ones[at - 1] > found[0]:
            found = (ones[at - 1], given[ones[at - 1]], ())
        for back in set(taker):
            if (at := bisect.bisect_right(sums, room + back)) and sums[at - 1] - back > found[0]:
                found = (sums[at - 1] - back, given[sums[at - 1]], (back,))
        diff = found[0]
        if diff and (g := 2 * diff * (have - fill + diff)) > gain:
            best, gain = (taker, found[1], found[2]), g
    return best


def pack(rows: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece"), length_column: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``: lengths of 1 to ``capacity`` packed into few sequences.

    ``rows`` should be cheap to read again (a stored table).  Ties and repeated rows each get a
    place; rows whose length is null or out of range raise an error; an empty table stays empty.
    Input columns ``sequence_id`` and ``offset`` are replaced; the keys and the length have other names.
    """
    made = ("sequence_id", "offset")
    if any(c.lower() in made for c in (*keys, length_column)):
        raise ValueError(f"a key or the length can't be named {' or '.join(made)}")
    spark = rows.sparkSession
    p = clash_free(rows)
    cells = max(1, -(-rows.count() // ROWS_PER_CELL))
    held = rows.withColumn(p + "cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
    counted = held.groupBy(F.col(length_column).alias(p + "length"), p + "cell").agg(F.count(F.lit(1)).alias(p + "n"))
    histogram: Counter = Counter()
    for length, n in counted.groupBy(p + "length").agg(F.sum(p + "n")).collect():  # as many rows as the capacity, at most
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"length {length} isn't between 1 and {capacity}")
        histogram[length] = n
    bins = improve(best_fit_decreasing(histogram, capacity), capacity) if histogram else Counter()
    # slots[length]: rank from which a pattern serves this length, its first sequence, how many it holds in each, their offsets
    slots: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for pattern, number in sorted(bins.items(), reverse=True):
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in pattern:
            offsets[length].append(at)
            at += length
        for length, places in offsets.items():
            slots[length].append((used[length], sequence, len(places), places))
            used[length] += number * len(places)
        sequence += number
    assert used == histogram, "every piece has one place"
    plan = spark.sparkContext.broadcast(dict(slots))  # bounded by the capacity, not by the data
    kept = [f for f in rows.schema.fields if f.name.lower() not in made]
    names = [f.name for f in kept]

    def place(source):
        slots = plan.value
        starts = {k: [s[0] for s in v] for k, v in slots.items()}
        for b in source:
            at = {c: b.schema.get_field_index(c) for c in b.schema.names}
            seqs, offs = [], []
            for length, rank in zip(b.column(at[length_column]).to_pylist(), b.column(at[p + "rank"]).to_pylist()):
                start, seq, each, places = slots[length][bisect.bisect_right(starts[length], rank) - 1]
                seqs.append(seq + (rank - start) // each)
                offs.append(places[(rank - start) % each])
            yield pa.RecordBatch.from_arrays([*(b.column(at[x]) for x in names), pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())], names=[*names, "sequence_id", "offset"])

    earlier = Window.partitionBy(p + "length").orderBy(p + "cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    before = counted.select(p + "length", F.col(p + "cell").alias(p + "of"), F.coalesce(F.sum(p + "n").over(earlier), F.lit(0)).alias(p + "first"))
    order = Window.partitionBy(length_column, p + "cell").orderBy(*keys)
    ranked = held.withColumn(p + "at", F.row_number().over(order)).join(before, (F.col(length_column) == F.col(p + "length")) & (F.col(p + "cell") == F.col(p + "of")))
    ranked = ranked.select(*[f"`{n}`" for n in names], (F.col(p + "first") + F.col(p + "at") - 1).alias(p + "rank"))
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ``ids_crc32`` and place: tokenised once, packed by length."""
    cut = pieces(df, vocabulary, id_column, text_column, capacity, end_id)
    slim = stored(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32")), "pieces")
    return pack(slim, capacity, ("doc_id", "piece", "ids_crc32"))


def sequences(packed: DataFrame, cut: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves; a sequence is at most ``capacity`` ids."""
    both = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held")).select("sequence_id", F.aggregate("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
