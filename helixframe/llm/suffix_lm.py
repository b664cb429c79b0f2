"""Language-model scoring with a probabilistic suffix tree (operator 2).

A text is its tokens' bytes, one space between tokens and an end mark.  Contexts are
suffixes of up to ``DEPTH`` bytes.  A context becomes a node of the tree if it is
frequent enough to judge and its next-symbol distribution diverges from its parent's
(a likelihood-ratio test); distributions are smoothed into their parents'
(Witten-Bell); scoring walks the automaton whose states are the longest retained
suffixes.

Scale: n-gram counts come from all training texts through partial and final
aggregation.  The least count of a context is absolute, so the tree grows with the
corpus and is never collected or broadcast: contexts that end alike are judged together
(``_judge``; only next symbols after at most one byte go through the driver), and each
block of documents receives the probabilities of its own grams, like the counts of its
own words, by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, release, stored, text_bytes

DEPTH = 5
#: Occurrences that a context needs to be judged, at any size of the corpus.
LEAST = 2
#: Nats that a context's own distribution must gain over its parent's, in all its occurrences and per symbol it predicts.
GAIN_PER_SYMBOL = 1.0
BLOCK_BYTES = 12 << 20
#: Counts or probabilities that a task holds before it sends them to their blocks.
PACKED_ROWS = 500_000
SPACE, END = 0x20, 0x0A
_PAD = bytes([END]) * DEPTH
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)  # no gram of DEPTH + 1 < 8 bytes
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = pa.schema([("block", pa.int32()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the ASCII-lower-cased text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join(words) + bytes([END])


def gram_counts(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (DEPTH + 1)-grams that end at each symbol of the streams, newest symbol in the low byte, and counts."""
    keys = np.sort(gram_keys(streams))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def gram_keys(streams: list[bytes]) -> np.ndarray:
    """The (DEPTH + 1)-gram that ends at each symbol of the streams, in order."""
    raw = np.frombuffer(b"".join(_PAD + s for s in streams), np.uint8)
    scored = np.ones(len(raw), bool)
    at = 0
    for s in streams:
        scored[at : at + DEPTH] = False
        at += DEPTH + len(s)
    keys = raw[DEPTH:].astype(np.uint64)
    for back in range(1, DEPTH + 1):
        keys |= raw[DEPTH - back : len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    return keys[scored[DEPTH:]]


def _blocks(df: DataFrame, id_column: str, text_column: str, train) -> tuple[DataFrame, int]:
    number = max(1, -(-text_bytes(df, text_column) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(id_column, text_column), F.lit(number)).cast("int")
    return df.select(block.alias("block"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(train, F.lit(True)).alias("train")), number


def _count_block(table: pa.Table) -> pa.Table:
    """Word and gram counts of one block (of training texts; 0 for words and grams only seen elsewhere)."""
    words: Counter = Counter()
    others: set = set()
    held: dict[bool, list] = {True: [], False: []}
    size, grams = {True: 0, False: 0}, []

    def flush(train: bool) -> None:
        if held[train]:
            g, c = gram_counts(held[train])
            grams.append((g, c if train else np.zeros_like(c)))
        held[train], size[train] = [], 0

    for text, train in zip(table.column("text"), table.column("train").to_pylist()):
        found = tokens(text.as_py())
        if train:
            words.update(found)
            words[b""] += 1  # the end token
        else:
            others.update(found)
        held[train].append(stream_of(found))
        size[train] += len(held[train][-1])
        if size[train] > 4 << 20:
            flush(train)
    flush(True)
    flush(False)
    block = table.column("block")[0].as_py()
    keys = [*words, *(w for w in others if w not in words)]
    n = np.asarray([words.get(w, 0) for w in keys], np.int64)
    out = [_rows(block, pa.array(keys, pa.binary()), pa.nulls(len(keys), pa.int64()), n)]
    if grams:
        g, c = np.concatenate([x for x, _ in grams]), np.concatenate([y for _, y in grams])
        order = np.argsort(g)
        g, c = g[order], c[order]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        out.append(_rows(block, pa.nulls(len(starts), pa.binary()), pa.array(g[starts].astype(np.int64)), np.add.reduceat(c, starts)))
    return pa.concat_tables(out)


def _rows(block: int, words: pa.Array, grams: pa.Array, n: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.full(len(n), block, np.int32)), words, grams, pa.array(n.astype(np.int64))], schema=_COUNTS)


class Shallow:
    """Next-symbol probabilities after no and one byte, as 256 x 256 tables: all that is worked out on the driver."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        own = np.zeros((256, 256))  # context, next
        own[gram >> 8, gram & 255] = n
        root = own.sum(axis=0)
        self.root = (root + 1) / (root.sum() + 256)
        total, kinds = own.sum(axis=1), np.count_nonzero(own, axis=1)
        valid = total >= LEAST
        with np.errstate(divide="ignore", invalid="ignore"):
            self.smooth = np.where(valid[:, None], (own + kinds[:, None] * self.root) / (total + kinds)[:, None], self.root)
            gain = np.where(own > 0, own * np.log(own / total[:, None] / self.root), 0).sum(axis=1)
        self.passed = valid & (gain > GAIN_PER_SYMBOL * kinds)
        self.near = np.where(self.passed[:, None], self.smooth, self.root)

    def fallback(self, deeper: np.ndarray) -> tuple[np.ndarray, int]:
        """log10 for grams without a longer retained context, and retained contexts; ``deeper`` tells first symbols with longer ones."""
        held = self.passed | deeper
        return np.log10(np.where(held[:, None], self.smooth, self.root)).astype(np.float32), 1 + int(held.sum())


def _judge(gram: np.ndarray, n: np.ndarray, shallow: Shallow) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted grams, log10 of their last symbols' probabilities (NaN: no context of two bytes or more is retained), retained contexts.

    The grams are all those whose contexts end in the same two bytes, so they hold whole subtrees.
    """
    order = np.argsort(gram)
    keys, counts, parents = [gram[order]], [n[order].astype(np.float64)], []
    for d in range(DEPTH - 1, 1, -1):  # counts of shorter contexts' next symbols
        k, parent = np.unique(keys[-1] & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        parents.append(parent)
        counts.append(np.bincount(parent, counts[-1], len(k)))
        keys.append(k)
    levels = []
    up = near = None
    for i in range(len(keys) - 1, -1, -1):  # shorter contexts first
        k, own = keys[i], counts[i]
        if up is None:
            first, nxt = (k >> 8) & 255, k & 255
            up, near = shallow.smooth[first, nxt], shallow.near[first, nxt]
        else:
            up, near = up[parents[i]], near[parents[i]]
        context = np.cumsum(np.concatenate(([False], (k[1:] >> 8) != (k[:-1] >> 8))))
        total, kinds = np.bincount(context, own), np.bincount(context, own > 0)
        valid = total >= LEAST
        held = own > 0
        gain = np.bincount(context[held], own[held] * np.log(own[held] / total[context[held]] / near[held]), len(total))
        passed = valid & (gain > GAIN_PER_SYMBOL * kinds)
        up = np.where(valid[context], (own + kinds[context] * up) / np.maximum(total + kinds, 1)[context], up)
        near = np.where(passed[context], up, near)
        levels.append((context, passed, up))
    levels.reverse()
    retained, below = 0, None
    kept = []
    for i, (context, passed, _) in enumerate(levels):  # the tree holds every suffix of a retained context
        if below is not None:
            passed = passed | (np.bincount(context[parents[i - 1]], below, len(passed)) > 0)
        below = passed[context]
        kept.append(below)
        retained += int(passed.sum())
    best = np.full(len(keys[-1]), np.nan)
    for i in range(len(keys) - 1, -1, -1):
        best = np.where(kept[i], levels[i][2], best if i == len(keys) - 1 else best[parents[i]])
    return keys[0], np.log10(best).astype(np.float32), retained


class GramTable:
    """Probabilities of one block's grams by an open hash table."""

    def __init__(self, gram: np.ndarray, log_p: np.ndarray):
        bits = max(4, int(2 * len(gram)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.float32)
        gram, at = gram.astype(np.uint64), self._slots(gram.astype(np.uint64))
        while len(gram):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = gram[free]
            placed = self.keys[at] == gram
            self.values[at[placed]] = log_p[placed]
            gram, log_p, at = gram[~placed], log_p[~placed], (at[~placed] + 1) & self.mask

    def _slots(self, gram: np.ndarray) -> np.ndarray:
        return ((gram * _MULTIPLIER) >> self.shift).astype(np.int64)

    def score(self, streams: list[bytes]) -> np.ndarray:
        """log10 probability of each stream; all its grams are in the table."""
        if not streams:
            return np.empty(0)
        gram = gram_keys(streams)
        at = self._slots(gram)
        rest = np.flatnonzero(self.keys[at] != gram)
        while len(rest):
            if (self.keys[at[rest]] == _EMPTY).any():
                raise KeyError("gram of a text is not in its block's table")
            at[rest] = (at[rest] + 1) & self.mask
            rest = rest[self.keys[at[rest]] != gram[rest]]
        ends = np.cumsum([len(s) for s in streams])
        return np.add.reduceat(self.values[at].astype(np.float64), np.concatenate(([0], ends[:-1])))


def gram_prices(grams: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """``gram, log_p`` of every gram (null: see the 256 x 256 table, by the last two symbols), that table, retained contexts."""
    spark = grams.sparkSession
    totals = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    pairs = totals.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    shallow = Shallow(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy())
    held = spark.sparkContext.broadcast(shallow)

    def judge(table: pa.Table) -> pa.Table:
        gram, log_p, retained = _judge(table.column("gram").to_numpy(), table.column("n").to_numpy(), held.value)
        stem = int(gram[0] >> 8) & 0xFFFF
        return pa.table({
            "gram": pa.array(np.append(gram, 0)), "log_p": pa.array(np.append(log_p, np.float32(0)), from_pandas=True),
            "stem": pa.array([None] * len(gram) + [stem], pa.int32()), "retained": pa.array([None] * len(gram) + [retained], pa.int64()),
        })

    stem = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    judged = stored(totals.withColumn("end", stem).groupBy("end").applyInArrow(judge, "gram long, log_p float, stem int, retained long"), "prices")
    drop_stored(totals)
    stems = judged.filter("retained > 0").groupBy(F.col("stem").bitwiseAND(F.lit(255)).alias("last")).agg(F.sum("retained").alias("n")).collect()  # 256 rows at most
    deeper = np.zeros(256, bool)
    deeper[[r["last"] for r in stems]] = True
    table, retained = shallow.fallback(deeper)
    return judged.filter("stem is null").select("gram", "log_p"), table, retained + sum(r["n"] for r in stems)


class SuffixTree:
    """The model in plain form, on one machine: smoothed distributions of retained contexts, and their automaton.

    Tests hold the distributed form (``gram_prices``) against it.
    """

    def __init__(self, level: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        seen = np.unique(symbol) if len(symbol) else np.empty(0, int)
        self.classes = np.full(256, len(seen), np.int64)  # every symbol never seen shares a class
        self.classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        counts: dict[tuple[int, int], np.ndarray] = {}
        for d, c, s, k in zip(level.tolist(), context.tolist(), self.classes[symbol].tolist() if len(symbol) else [], n.tolist()):
            counts.setdefault((d, c), np.zeros(width))[s] = k
        parent = lambda d, c: (d - 1, c & ((1 << 8 * (d - 1)) - 1))  # noqa: E731  the context without its oldest symbol
        root = counts.get((0, 0), np.zeros(width))
        base = (root + 1) / (root.sum() + 256)  # the last class's share is that of one unseen symbol
        smooth = {(0, 0): base}
        kept = {(0, 0)}
        for key in sorted(counts):  # shorter contexts first
            d, _ = key
            if not d:
                continue
            up = smooth.get(parent(*key))
            if up is None:
                continue
            own = counts[key]
            total, kinds = own.sum(), np.count_nonzero(own)
            smooth[key] = (own + kinds * up) / (total + kinds)
            near = parent(*key)
            while near not in kept:
                near = parent(*near)
            held = own > 0
            gain = float((own[held] * np.log(own[held] / total / smooth[near][held])).sum())
            if gain > GAIN_PER_SYMBOL * kinds:
                kept.add(key)
        for d, c in list(kept):  # the tree holds every suffix of a retained context
            while d:
                d, c = parent(d, c)
                kept.add((d, c))
        states = set(kept)
        for d, c in kept:  # and the automaton every prefix, so that a state tells the next one
            for cut in range(1, d):
                states.add((d - cut, c >> 8 * cut))
        order = sorted(states)
        number = {s: i for i, s in enumerate(order)}
        longest = lambda d, c, among: next(k for k in ((x, c & ((1 << 8 * x) - 1)) for x in range(d, -1, -1)) if k in among)
        self.log_p = np.empty((len(order), width), np.float32)
        self.move = np.empty((len(order), width), np.int32)
        symbols = [*seen.tolist(), None]
        for i, (d, c) in enumerate(order):
            self.log_p[i] = np.log10(smooth[longest(d, c, kept)])
            for j, s in enumerate(symbols):
                if s is None:
                    self.move[i, j] = number[0, 0]
                elif d == DEPTH:
                    self.move[i, j] = number[longest(DEPTH, ((c << 8) | s) & ((1 << 8 * DEPTH) - 1), number)]
                else:
                    self.move[i, j] = number[longest(d + 1, (c << 8) | s, number)]
        self.retained = len(kept)

    def score(self, streams: list[bytes], lanes: int = 4096) -> np.ndarray:
        """log10 probability of each stream.  All lanes walk the automaton in step; a lane's first
        DEPTH symbols only bring it into the state that any history would."""
        if not streams:
            return np.empty(0)
        raw = self.classes[np.frombuffer(b"".join(_PAD + s for s in streams), np.uint8)].astype(np.uint8 if self.log_p.shape[1] <= 256 else np.uint16)
        width = self.log_p.shape[1]
        move, log_p = self.move.ravel(), self.log_p.ravel()
        lanes = max(1, min(lanes, len(raw) // 64))
        length = -(-len(raw) // lanes)
        padded = np.zeros(DEPTH + lanes * length, raw.dtype)
        padded[DEPTH : DEPTH + len(raw)] = raw
        got = np.empty((length, lanes), np.float32)
        starts = np.arange(lanes) * length
        state = np.zeros(lanes, np.int64)
        for t in range(length + DEPTH):
            at = state * width + padded[starts + t]
            if t >= DEPTH:
                got[t - DEPTH] = log_p[at]
            state = move[at].astype(np.int64)
        flat = got.T.ravel()[: len(raw)]
        bounds, pos = np.empty(2 * len(streams), np.int64), 0
        for i, s in enumerate(streams):
            bounds[2 * i], bounds[2 * i + 1] = pos + DEPTH, pos + DEPTH + len(s)
            pos += DEPTH + len(s)
        return np.add.reduceat(np.append(flat, 0).astype(np.float64), bounds)[::2]


def score_texts(df: DataFrame, train, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of every text by a model of those texts for which the column ``train`` holds (null: yes).

    ``doc_id, train, n_tokens, n_known, train_tokens, vocabulary, base_score, score, states``.
    ``base_score`` is the add-one unigram score of the tokens and the end; ``score`` the suffix
    tree's.  Null and empty texts are the end token alone.  Repeated rows are scored each.  With no
    training text, all symbols are equally likely.  An empty table gives an empty table.
    """
    spark = df.sparkSession
    blocks, _ = _blocks(df, id_column, text_column, train)
    counts = stored(blocks.groupBy("block").applyInArrow(_count_block, "block int, word binary, gram long, n long"), "counts")
    release(spark)
    words = counts.filter("word is not null").select("block", "word", "n")
    per_word = Window.partitionBy("word")  # a word has one row per block at most
    lexicon = stored(words.select("block", "word", F.sum("n").over(per_word).alias("c"), (F.min("block").over(per_word) == F.col("block")).alias("first")), "lexicon")
    total = lexicon.filter("first and c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, vocabulary = int(total["n"] or 0), int(total["v"] or 0)
    grams = counts.filter("gram is not null").select("block", "gram", "n")
    prices, table, states = gram_prices(grams)
    release(spark)
    fallback = spark.sparkContext.broadcast(table)

    def score(docs: pa.Table, counts: dict, gram: np.ndarray, log_p: np.ndarray) -> pa.Table:
        model = GramTable(gram, np.where(np.isnan(log_p), fallback.value[(gram >> 8) & 255, gram & 255], log_p))
        divisor = math.log10(n_train + vocabulary + 1)
        costs = np.log10(np.fromiter(counts.values(), np.int64, len(counts)) + 1.0) - divisor  # a word never trained on costs exactly -divisor
        cost = dict(zip(counts, costs.tolist()))
        cost_of, end_cost = cost.__getitem__, cost[b""]
        base, n_tokens, n_known, streams, scores, size = [], [], [], [], [], 0
        for text in docs.column("text"):
            found = tokens(text.as_py())
            each = [*map(cost_of, found), end_cost]
            base.append(math.fsum(each))
            n_tokens.append(len(each))
            n_known.append(len(each) - each.count(-divisor))
            streams.append(stream_of(found))
            size += len(streams[-1])
            if size > 4 << 20:
                scores.append(model.score(streams))
                streams, size = [], 0
        scores.append(model.score(streams))
        rows = docs.num_rows
        return pa.table({
            "doc_id": docs.column("doc_id"), "train": docs.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([n_train] * rows, pa.int64()), "vocabulary": pa.array([vocabulary] * rows, pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(scores)), "states": pa.array([states] * rows, pa.int64()),
        })

    end_row = lexicon.filter("word = X'' and first").select("c").first()
    end_count = int(end_row["c"]) if end_row else 0
    own = _packed(lexicon.filter("length(word) > 0").select("block", "word", "c"), "word", np.int64)
    own = own.unionByName(_packed(grams.drop("n").join(prices, "gram").select("block", "gram", "log_p"), "gram", np.float32))
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double, states long"

    def with_own(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cost, gram, log_p = {b"": end_count}, [], []
        for words, grams, values in zip(*(right.column(c).to_pylist() for c in ("words", "grams", "measures"))):
            if words is not None:
                cost.update(zip(words.split(b" "), np.frombuffer(values, np.int64).tolist()))
            else:
                gram.append(np.frombuffer(grams, np.int64))
                log_p.append(np.frombuffer(values, np.float32))
        return score(left, cost, np.concatenate([np.empty(0, np.int64), *gram]), np.concatenate([np.empty(0, np.float32), *log_p]))

    return blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(with_own, schema)


def _packed(rows: DataFrame, key: str, kind) -> DataFrame:
    """``block, words, grams, measures``: the rows ``block, key, number`` of a task by block, as bytes.

    Words are joined by a space, as no token holds one.
    """

    def flush(held):
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        block = t.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        block, keys, numbers = block[order], t.column(1).take(pa.array(order)), t.column(2).to_numpy()[order].astype(kind)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        made = []
        for low, high in zip(starts, [*starts[1:], len(block)]):
            own = keys.slice(low, high - low)
            made.append(b" ".join(own.to_pylist()) if key == "word" else own.to_numpy().astype(np.int64).tobytes())
        none, cells = pa.nulls(len(made), pa.binary()), pa.array(made, pa.binary())
        values = pa.array([numbers[low:high].tobytes() for low, high in zip(starts, [*starts[1:], len(block)])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), *((cells, none) if key == "word" else (none, cells)), values], names=["block", "words", "grams", "measures"])

    def run(source):
        held, n = [], 0
        for b in source:
            held.append(b)
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield from flush(held)
                held, n = [], 0
        yield from flush(held)

    return rows.mapInArrow(run, "block int, words binary, grams binary, measures binary")
