"""Importance resampling towards a target's word distribution, by word tries (operator 13).

Features are all runs of 1 to ``longest`` consecutive words.  Each task grows a trie of its rows'
words: a node is a run of words, reached from its parent by one word, and holds the run's CRC
state (the parent's, carried on over a space and the word) and how often the run occurred.  At the
end of a task, and whenever the trie has ``NODES`` nodes, the counts are added to their buckets and
the trie starts anew, so memory is bounded and nothing is dropped.  Bucket totals of all tasks are
merged by one aggregation of at most ``buckets`` rows a task.  To score, the gains of all buckets are broadcast
(their number is a parameter), every node receives its bucket's gain when it is made, and a
document's weight is the sum along the paths that it walks.

Drawing without replacement is the Gumbel trick: the highest scores win.  The order over all rows
comes from one range partitioning of narrow rows and counts per partition.

Defined results: null and empty texts have no features, weight 0 and too few words to be drawn.
Null ids are hashed as an empty text and come last among ties.  Repeated rows and repeated ids are
judged one by one, in any order among themselves.  An empty target gives gains from the corpus alone,
an empty corpus an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clash_free, drop_stored, parts, stored, tuned

LONGEST = 1
BUCKETS = 10_000
#: Nodes of a task's trie before its counts go to the buckets and it starts anew; some 200 bytes each.
NODES = 500_000
#: Bytes of a text that are cut into words at once.
CHUNK = 1 << 20

# A-Z become a-z; other characters of ASCII that aren't 0-9 or a-z become spaces; bytes of longer characters stay.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes | None):
    """Words of a UTF-8 text, in order; a chunk at a time, for very long texts."""
    if not text:
        return
    if len(text) <= CHUNK:
        yield from text.translate(_FOLDED).split()
        return
    held = b""
    for at in range(0, len(text), CHUNK):
        piece = held + text[at : at + CHUNK].translate(_FOLDED)
        cut = piece.rfind(b" ") + 1
        yield from piece[:cut].split()
        held = piece[cut:]
    yield from held.split()


class Trie:
    """Runs of words as paths from node 0.

    With ``gains``, a node is worth its bucket's gain; with ``totals``, counts are added there whenever the trie starts anew.
    """

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None, totals: np.ndarray | None = None):
        self.longest, self.buckets, self.gains, self.totals = longest, buckets, gains, totals
        self.length = 0
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.state, self.count, self.worth = [0], [0], [0]

    def _grown(self, node: int, word: bytes) -> int:
        new = len(self.state)
        state = zlib.crc32(word, zlib.crc32(b" ", self.state[node]) if node else 0)
        self.children[node][word] = new
        self.children.append({})
        self.state.append(state)
        self.count.append(0)
        self.worth.append(self.gains[state % self.buckets] if self.gains is not None else 0)
        return new

    def _child(self, node: int, word: bytes) -> int:
        return self.children[node].get(word) or self._grown(node, word)

    def walk(self, text: bytes | None):
        """Nodes of all runs of the text's words; ``length`` is the number of its words so far."""
        self.length, ends, recent = 0, [], []
        for word in words(text):
            self.length += 1
            if len(self.state) > NODES:
                self.flush()
                ends = [0] * len(recent)
                for i, w in enumerate(recent):  # the runs that are still open, in the new trie
                    ends[: i + 1] = [self._child(node, w) for node in ends[: i + 1]]
            ends.append(0)
            ends = [self._child(node, word) for node in ends]
            yield from ends
            if self.longest > 1:
                recent.append(word)
            if len(ends) == self.longest:
                del ends[0]
                del recent[:1]

    def flush(self) -> None:
        """Add the counts to their buckets and start anew."""
        if self.totals is not None:
            np.add.at(self.totals, np.asarray(self.state[1:], np.int64) % self.buckets, np.asarray(self.count[1:], np.int64))
        self._clear()


def bucket_counts(df: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of the texts fall into each bucket that has any."""
    tuned(df.sparkSession)

    def run(source):
        totals = np.zeros(buckets, np.int64)
        trie = Trie(longest, buckets, totals=totals)
        for batch in source:
            for t in batch.column(0):
                for node in trie.walk(t.as_py()):
                    trie.count[node] += 1
        trie.flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at])], names=["bucket", "n"])

    return df.select(F.col(text).cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln(target share / corpus share)) of each bucket, each share smoothed by one for each bucket."""
    big, small = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * big / ((corpus.get(b, 0) + 1) * small))) for b in range(buckets)]


def weigh(df: DataFrame, text: str, gains: list[int], longest: int = LONGEST) -> DataFrame:
    """``df`` with ``n_words``, ``n_features`` and ``weight`` (the gains' sum over the features); columns of these names are replaced."""
    tuned(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(gains)
    h = clash_free(df)
    names = [c for c in df.columns if c not in ("n_words", "n_features", "weight")]
    body = f"{h}text"

    def run(source):
        trie = Trie(longest, len(sent.value), sent.value)
        for batch in source:
            n_words, n_features, weight = [], [], []
            for t in batch.column(body):
                total = n = 0
                for node in trie.walk(t.as_py()):
                    total += trie.worth[node]
                    n += 1
                n_words.append(trie.length)
                n_features.append(n)
                weight.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=[*names, "n_words", "n_features", "weight"])

    schema = df.select(*names).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return df.select(*names, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


def gumbel(key, seed: int = 2024):
    """floor(1000 * Gumbel noise) of a key, from the first 32 bits of sha256 of ``<seed>:<key>``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, id_column: str, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: 1, 2, 3, ... of the drawn rows, null of the others.

    Of the N rows with ``least_words`` words the floor(percent * N / 100) highest scores are drawn, ties to smaller ids.
    """
    h = clash_free(weighed)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col(id_column), seed)).withColumn(f"{h}in", F.col("n_words") >= least_words)
    order = [F.col(f"{h}in").desc(), F.col("score").desc(), F.col(id_column).asc_nulls_last(), F.col(f"{h}row")]
    scored = stored(scored.withColumn(f"{h}row", F.monotonically_increasing_id()), "weighed")
    placed = scored.repartitionByRange(parts(scored.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn(f"{h}place", F.monotonically_increasing_id()), "placed")
    drop_stored(scored)
    # the place is 2^33 * partition + row of the partition; a count for each partition goes to the driver
    split, counts = F.shiftright(f"{h}place", 33), {}
    for r in placed.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum(F.col(f"{h}in").cast("long")).alias("own")).toArrow().to_pylist():
        counts[r["split"]] = (r["n"], r["own"])
    number = sum(own for _, own in counts.values())
    before, start = [], 0
    for s in sorted(counts):
        before.append((s, start))
        start += counts[s][0]
    starts = F.broadcast(placed.sparkSession.createDataFrame(before, f"{h}split long, {h}start long"))  # a row for each partition
    rank = F.col(f"{h}start") + F.col(f"{h}place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = placed.withColumn(f"{h}split", split).join(starts, f"{h}split")
    names = [c for c in weighed.columns if c not in ("score", "rank")]
    return placed.select(*names, "score", F.when(F.col(f"{h}in") & (rank <= percent * number // 100), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``id, n_words, n_features, weight, score, rank`` of every row of ``docs``."""
    held = lambda df: {r["bucket"]: r["n"] for r in df.toArrow().to_pylist()}  # noqa: E731  a number for each bucket
    gains = gains_of(held(bucket_counts(docs, text, longest, buckets)), held(bucket_counts(target, target_text, longest, buckets)), buckets)
    weighed = weigh(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", gains, longest).drop("text")
    return draw(weighed, "id", least_words, percent, seed)
