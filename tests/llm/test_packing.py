import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing as pk

from .util import AWKWARD, clashing, documents, empty, real_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def check(spark, rows, capacity=2048):
    got = pk.pack_documents(clashing(documents(spark, rows)), PATH, capacity=capacity).collect()
    text, by_doc, by_seq = dict(rows), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(text)
    for i, pieces in by_doc.items():
        whole, at = ids(text[i]), 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert k == 0 or r["length"] == capacity
            part = np.asarray(whole[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(whole)
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq), -(-sum(len(ids(t)) for t in text.values()) // capacity)


def test_awkward(spark):
    check(spark, AWKWARD)
    check(spark, AWKWARD, 64)
    assert pk.pack_documents(empty(spark), PATH).count() == 0


def test_real_reaches_nearly_the_lower_bound(spark):
    used, least = check(spark, real_texts(1000))
    assert used <= 1.01 * least


def test_repeats_and_cells(spark, monkeypatch):
    monkeypatch.setattr(pk, "ROWS_PER_CELL", 50)
    rows = [(i, "the same words again" if i % 3 else f"number {i}") for i in range(300)]
    check(spark, rows, 32)


def test_tokenizer_on_odd_spaces():
    tok = pk.bulk_tokenizer(open(PATH, encoding="utf-8").read())
    r = random.Random(3)
    texts = ["".join(r.choices([" ", "  ", "\n", "\t", "a", "bc", "É", "7", "'s", ".", ",", "<|endoftext|>", "\xa0", "　", "\x85", "\x1c", "\U0001f600"], k=r.randint(0, 25))) for _ in range(1500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_search_only_moves_pieces():
    r = random.Random(4)
    for _ in range(20):
        histogram = Counter(r.choices(range(1, 101), k=300))
        bins = pk.best_fit_decreasing(histogram, 100)
        better = pk.improve(bins, 100)
        for b in (bins, better):
            assert sum((Counter({x: c * n for x, c in Counter(p).items()}) for p, n in b.items()), Counter()) == histogram
            assert all(sum(p) <= 100 for p in b)
        assert sum(better.values()) <= sum(bins.values())
        fill = lambda b: sum(sum(p) ** 2 * n for p, n in b.items())
        assert fill(better) >= fill(bins)


def test_search_empties_a_bin():
    """Best fit leaves three bins where two suffice; exchanges find them."""
    start = Counter({(6, 3): 1, (5, 2): 1, (2, 2): 1})
    assert sum(pk.improve(start, 10).values()) == 2


def test_sequences(spark):
    cut = pk.pieces(documents(spark, AWKWARD[:6]), PATH, capacity=16)
    made = pk.sequences(pk.pack(cut.select("doc_id", "piece", "start", "length"), 16), cut).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * sum(len(ids(t)) for _, t in AWKWARD[:6])


def test_bad_lengths(spark):
    with pytest.raises(ValueError):
        pk.pack(spark.createDataFrame([(1, 0, 99)], "doc_id long, piece int, length long"), 10)


def test_clashing_names(spark):
    rows = spark.createDataFrame([(i, 0, 5 + i % 3, "own", "mine") for i in range(20)], "doc_id long, piece int, length long, Sequence_ID string, offset string")
    got = pk.pack(rows, 16)
    assert [c.lower() for c in got.columns].count("sequence_id") == 1 and got.columns.count("offset") == 1
    assert sorted(r["offset"] for r in got.collect())[0] == 0 and got.count() == 20
    with pytest.raises(ValueError):
        pk.pack(rows, 16, length_column="offset")
