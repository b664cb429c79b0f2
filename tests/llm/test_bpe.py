import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import bpe

from .util import AWKWARD, clashing, documents, empty, real_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.WordBpe(open(PATH, encoding="utf-8").read())


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_real_texts_as_the_library():
    for _, text in [*AWKWARD, *real_texts(300)]:
        ids, decoded = library(text)
        assert OWN.encode(text).tolist() == ids
        assert OWN.decode(ids) == decoded


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_as_the_library(text):
    assert OWN.encode(text).tolist() == library(text)[0]


def test_every_code_point_between_letters():
    import unicodedata

    known, unknown = [], []
    for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]:
        (unknown if unicodedata.category(chr(c)) == "Cn" else known).append(chr(c))
    assert len(known) > 250_000  # private use included
    for found, step in ((known, 1), (unknown, 23)):  # every text of the second kind takes one path
        found = found[::step]
        for i in range(0, len(found), 2000):
            text = " ".join(f"a{c}B {c}" for c in found[i : i + 2000])
            assert OWN.encode(text).tolist() == library(text)[0], hex(ord(found[i]))


def test_code_points_newer_than_python_tables():
    for c in (0x0558, 0x058B, 0x088F, 0x10950, 0x1C89, 0xA7CB, 0xA7DC):
        for text in (chr(c), f"a{chr(c)}b", f"Ab {chr(c)} it's é{chr(c)}"):
            assert OWN.encode(text).tolist() == library(text)[0], hex(c)


def test_long_words_take_the_heap_to_the_same_ids():
    for word in ("abcde" * 200, "zz" * 700, "a" * 999):
        ids = [OWN.inner[b] for b in word.encode()[:-1]] + [OWN.last[ord(word[-1])]]
        assert OWN._scan(list(ids)) == OWN._heap(list(ids)) == library(word)[0]


def test_a_full_cache_changes_nothing():
    small = bpe.WordBpe(open(PATH, encoding="utf-8").read(), cache_items=3)
    for _, text in real_texts(20):
        assert small.encode(text).tolist() == OWN.encode(text).tolist()


def test_operator(spark):
    made = bpe.encode_decode(clashing(documents(spark)), "text", PATH).collect()
    assert len(made) == len(AWKWARD)
    for r in made:
        assert (r["ids"], r["decoded"]) == library(r["text"])
    assert bpe.encode_decode(empty(spark), "text", PATH).count() == 0
    back = bpe.decode(bpe.encode(documents(spark), "text", PATH), "ids", PATH).collect()
    assert all(r["decoded"] == library(r["text"])[1] for r in back)


def test_query(spark):
    from helixframe.llm.queries import op1_bpe

    rows = {r["doc_id"]: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for i, text in real_texts(200, "sf0.001"):
        ids, decoded = library(text)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "own", "mine")], "doc_id long, text string, _decoded string, _hdecoded string")
    got = bpe.encode(df, "text", PATH).first()
    assert (got["_decoded"], got["_hdecoded"]) == ("own", "mine") and got["ids"]
