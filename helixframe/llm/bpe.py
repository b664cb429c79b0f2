"""Byte-pair encoding and decoding of whole texts (operator 1).

Method: a contiguous rank array.  The symbols of a short word and the ranks of
their adjacent pairs lie in two parallel lists; the lowest rank is found by
scanning, its boundary is deleted and only the two neighbouring ranks are
refreshed.  Words beyond ``LONG_WORD`` symbols, where repeated scans would be
quadratic, take the same merges from a heap over a linked list.

Text is cut at white space and at the pattern's word borders, and each distinct word is
encoded once per worker (a bounded cache), so cost follows the number of distinct words.

Texts that hold a code point which Python's Unicode tables don't know are normalised and cut into
words by the tokenizers library, whose tables may be newer; the merges are the same code.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import clash_free

LONG_WORD = 256
CACHE_ITEMS = 500_000

# White space by the Unicode property, as the tokenizer's pattern engine has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Separators that Python's str.split() takes for white space and the pattern engine does not.
PYTHON_ONLY_SPACE = "\x1c-\x1f"
# Fixed value: the pre-tokenizer pattern of the vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE_SPACE + r"\p{L}\p{N}]+"
# Fixed value: the same for lower-case ASCII.
ASCII_WORD_PATTERN = r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(256 + len(symbols) - len(printable))
    return [symbols[b] for b in range(256)]


_assigned: set[str] = set()  # characters seen so far that Python's Unicode tables know


def has_unknown(text: str) -> bool:
    """Whether a text holds a code point that Python's Unicode tables class as unassigned."""
    for c in set(text) - _assigned:
        if unicodedata.category(c) == "Cn":
            return True
        _assigned.add(c)
    return False


class WordBpe:
    """Encoder and decoder for a word-end BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, spec: str, cache_items: int = CACHE_ITEMS):
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in parsed.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (vocab | self.added).items()}
        self.vocab = vocab
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        self.words = regex.compile(WORD_PATTERN)
        self.ascii_words = re.compile(ASCII_WORD_PATTERN)
        self.spaces = regex.compile(f"[{WHITE_SPACE}]+")
        self.odd_space = re.compile(f"[{PYTHON_ONLY_SPACE}]")
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.spec, self._library, self.bytes = spec, None, {c: b for b, c in enumerate(symbols)}
        self.cached_words: dict[str, bytes] = {}
        self.cache_items = cache_items

    def normalize(self, text: str) -> str:
        """NFC, then lower case letter by letter (no context rule for a final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def word_ids(self, word: str) -> list[int]:
        return self._merged(word.encode("utf-8", "replace"))

    def _merged(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        return self._scan(ids) if len(ids) <= LONG_WORD else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        merged, rank_of = self.merged, self.pairs.get
        none = len(merged)
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            now = ids[at] = merged[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((now, ids[at + 1]), none)
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], now), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        queue = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := self.pairs.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i] = self.merged[rank]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := self.pairs.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := self.pairs.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(queue, (r, before[i]))
        return [x for x, keep in zip(ids, alive) if keep]

    def _word(self, word: str) -> bytes:
        found = self.cached_words.get(word)
        if found is None:
            found = array("i", self.word_ids(word)).tobytes()
            if len(word) <= 64:
                if len(self.cached_words) >= self.cache_items:
                    self.cached_words.clear()
                self.cached_words[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        """A piece without white space: one word, or several with punctuation."""
        if piece.isalpha():
            return self._word(piece)
        if piece[:-1].isalpha():  # a word and one mark, the common case
            found = [piece[:-1], piece[-1]] if piece[-1] in ".,;:!?)" else self.words.findall(piece)
        else:
            found = self.words.findall(piece)
        return b"".join([self._word(w) for w in found])

    def _by_library(self, text: str) -> bytes:
        """Words as the library normalises and cuts them, in its byte symbols."""
        if self._library is None:
            self._library = Tokenizer.from_str(self.spec)
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return b"".join([array("i", self._merged(bytes(map(self.bytes.__getitem__, w)))).tobytes() for w, _ in words if w])

    def _plain(self, text: str) -> bytes:
        if not text.isascii() and has_unknown(text):
            return self._by_library(text)
        text = self.normalize(text)
        if text.isascii() and not self.odd_space.search(text):
            cached, word = self.cached_words.get, self._word
            return b"".join([cached(w) or word(w) for w in self.ascii_words.findall(text)])
        pieces = [p for p in self.spaces.split(text) if p] if self.odd_space.search(text) else text.split()
        cached, piece = self.cached_words.get, self._piece
        return b"".join([cached(p) or piece(p) for p in pieces])

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids; a null or empty text has none.  Special tokens' strings become their ids."""
        if not text:
            return np.empty(0, np.int32)
        if self.specials is None or not self.specials.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        out = []
        for part in self.specials.split(text):
            out.append(np.int32(self.added[part]).tobytes() if part in self.added else self._plain(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by one space, as the vocabulary has no decoder of its own."""
        token = self.tokens
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def codec(spec: str) -> WordBpe:
    return WordBpe(spec)


def load_spec(spark: SparkSession, path: str):
    """Read a vocabulary file on the driver and broadcast it (its size is fixed: a vocabulary, not data)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(df: DataFrame, text_column: str, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the token ids of each whole text and the text decoded from them.

    Null and empty texts give an empty list and an empty string; rows are never merged, so
    repeated rows and ties stay; an empty table gives an empty table.  Existing columns named
    like the outputs are replaced.
    """
    spec = load_spec(df.sparkSession, vocabulary)
    kept = [f for f in df.schema.fields if f.name.lower() not in (ids.lower(), decoded.lower())]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    names = [f.name for f in kept]

    def run(source):
        bpe = codec(spec.value)
        for b in source:
            if not b.num_rows:
                continue
            held = [bpe.encode(t.as_py()) for t in b.column(b.schema.get_field_index(text_column))]
            offsets = np.zeros(len(held) + 1, np.int32)
            np.cumsum([len(h) for h in held], out=offsets[1:])
            flat = np.concatenate(held)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            texts = pa.array([bpe.decode(h.tolist()) for h in held], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), lists, texts], names=[*names, ids, decoded])

    if text_column in names:
        source = df.select(*[f"`{n}`" for n in names])
    else:
        raise ValueError(f"{text_column} can't be an output column")
    return source.mapInArrow(run, schema)


def encode(df: DataFrame, text_column: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` with token ids only."""
    decoded = clash_free(df) + "decoded"
    return encode_decode(df, text_column, vocabulary, ids, decoded).drop(decoded)


def decode(df: DataFrame, ids_column: str, vocabulary: str, text: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of token ids; null ids give an empty text, unknown ids are left out."""
    spec = load_spec(df.sparkSession, vocabulary)
    kept = [f for f in df.schema.fields if f.name.lower() != text.lower()]
    names = [f.name for f in kept]

    def run(source):
        bpe = codec(spec.value)
        for b in source:
            held = pa.array([bpe.decode(x.as_py() or ()) for x in b.column(b.schema.get_field_index(ids_column))], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), held], names=[*names, text])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))
