import hashlib

import numpy as np
import pytest

from helixframe.llm import fingerprint as fp

from .util import AWKWARD, clashing, documents, empty, near_copies, real_texts


def brute(rows):
    order = sorted(rows)
    out = {}
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        out[i] = (len(t), t[: len(t) - q] + nxt[:q] if q else t)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edits_follow_the_next_document(spark, ranges):
    rows = [(i, t or "") for i, t in AWKWARD] + [(i + 1000, t) for i, t in real_texts(120)]

    def run(items):
        held = [(d, t, n) for d, t, n in items]
        if held:
            yield __import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(c) for c in zip(*held)], names=["doc_id", "text", "following"])

    got = fp.with_next(documents(spark, rows), run, "doc_id long, text string, following string", ranges=ranges).collect()
    assert {r["doc_id"]: fp.edited_text(r["text"], r["following"]) for r in got} == {i: e for i, (_, e) in brute(rows).items()}
    assert len(got) == len(rows)


def test_operator(spark):
    got = fp.fingerprint_edits(clashing(documents(spark))).collect()
    want = brute(AWKWARD)
    assert len(got) == len(AWKWARD)
    for r in got:
        assert (r["n_chars"], r["edited"]) == want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fp.fingerprint_edits(empty(spark)).count() == 0
    one = fp.fingerprint_edits(documents(spark, [(1, "alone here")])).collect()
    assert [r["near_next"] for r in one] == [1.0]
    twice = fp.fingerprint_edits(documents(spark, [(1, "b"), (1, "a"), (None, "c")])).collect()
    assert len(twice) == 3


def test_estimates():
    for _, t in real_texts(40):
        s = fp.shingles(t, 5)
        half = t[: len(t) // 2]
        a, b = fp.sketch(t), fp.sketch(half)
        truth = fp.shingles(half, 5)
        both = len(np.intersect1d(s, truth)) / max(1, len(np.union1d(s, truth)))
        if len(t.split()) > 40:
            assert abs(fp.resemblance(a, b) - both) < 0.2
            assert abs(fp.distinct(a) / len(s) - 1) < 0.5
            assert fp.containment(b, a) > 0.7
        assert fp.resemblance(a, a) == 1
    rows = [t for _, t in near_copies(2)]
    assert fp.resemblance(fp.sketch(rows[0]), fp.sketch(rows[0])) == 1


def test_sketches_merge(spark):
    texts = [t for _, t in real_texts(60)]
    parts = fp.fingerprints(documents(spark, list(enumerate(texts)))).selectExpr("doc_id % 3 as g", "sketch")
    got = {r["group"]: fp.from_bytes(bytes(r["sketch"])) for r in fp.merge_sketches(parts, "g", salts=4).collect()}
    for g in range(3):
        whole = fp.merge(*(fp.sketch(t) for i, t in enumerate(texts) if i % 3 == g))
        assert (got[g] == whole).all()
        assert fp.from_bytes(fp.to_bytes(whole)).tolist() == whole.tolist()


def test_query(spark):
    from helixframe.llm.queries import op10_fingerprint

    rows = real_texts(200, "sf0.001")
    want = brute(rows)
    prints = {}
    for r in op10_fingerprint(spark, "/root/testdata/sf0.001").collect():
        n, edited = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_one_text_of_megabytes(spark):
    rows = [(1, "few words here"), (2, " ".join(f"w{i % 5000}" for i in range(3_000_000))), (3, "x" * 20_000_000), (4, None)]
    got = {r["doc_id"]: r["n_chars"] for r in fp.fingerprint_edits(documents(spark, rows)).select("doc_id", "n_chars").collect()}
    assert got == {i: len(t or "") for i, t in rows}
