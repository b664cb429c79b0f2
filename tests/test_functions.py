"""Golden values and string-level properties of the column functions and alignments."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import align as A
from helixframe.functions import seq as S
from helixframe.functions import stats
from helixframe.functions import text as T


def turn(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def random_seqs(n, length, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices("ACGT", k=length)) for _ in range(n)]


@pytest.mark.parametrize("k", [9, 21, 31])
def test_kmer_functions(spark, k):
    words = random_seqs(40, k)
    df = spark.createDataFrame([(w,) for w in words], "k string")
    c = F.col("k")
    got = df.select("k", S.revcomp(c).alias("rc"), S.canonical(c).alias("canon"), S.pack(c).alias("p"), S.unpack(S.pack(c), k).alias("u"), S.push_right(c, F.lit("A")).alias("pr"), S.push_left(c, F.lit("G"), k).alias("pl")).collect()
    for r in got:
        w = r["k"]
        assert r["rc"] == turn(w)
        assert r["canon"] == min(w, turn(w), key=lambda x: x[::-1])
        assert r["p"] == sum("ACGT".index(b) << 2 * i for i, b in enumerate(w))
        assert r["u"] == w
        assert (r["pr"], r["pl"]) == (w[1:] + "A", "G" + w[:-1])


def test_reverse_complement_chain(spark):
    r = spark.createDataFrame([("AGCTTGCT",)], "s string").select(F.reverse("s").alias("a"), S.complement(F.reverse("s")).alias("b"), S.revcomp(S.revcomp(F.col("s"))).alias("c"), S.revcomp(F.lit("ANG")).alias("n")).first()
    assert (r["a"], r["b"], r["c"], r["n"]) == ("TCGTTCGA", "AGCAAGCT", "AGCTTGCT", "CNT")


def test_masks(spark):
    df = spark.createDataFrame([(0,)], "m int")
    m = S.mark(S.mark(F.col("m"), S.left_bit(F.lit("A"))), S.right_bit(F.lit("C")))
    both = S.mark(m, S.right_bit(F.lit("G")))
    r = df.select(S.left_degree(m).alias("l"), S.right_degree(m).alias("r"), S.right_degree(both).alias("r2"), S.has(m, S.left_bit(F.lit("A"))).alias("has"), S.revcomp_mask(m).alias("rc")).first()
    assert (r["l"], r["r"], r["r2"], r["has"], r["rc"]) == (1, 1, 2, True, 0b00100001)


def test_poisson_golden(spark):
    r = spark.range(1).select(*[stats.poisson(F.lit(n), F.lit(10.0)).alias(f"p{n}") for n in (10, 100, 1000)]).first()
    assert r["p10"] == pytest.approx(0.12511003572113349, rel=1e-12)
    assert r["p100"] == pytest.approx(4.8646491820674864e-63, rel=1e-12)
    assert r["p1000"] == 0


def test_log_ratio_is_finite_far_out(spark):
    r = spark.range(1).select(stats.log10_poisson_ratio(F.lit(5000.0), F.lit(1.0), F.lit(4000.0)).alias("x")).first()["x"]
    assert r == pytest.approx((5000 * -np.log(4000) - 1 + 4000) / np.log(10))


@pytest.mark.parametrize(("b", "score"), [("ACGTACGTAC", 10), ("ACGTACGCAC", 8), ("ACGTACCGTAC", 7), ("ACGTAGTAC", 6)])
def test_golden_alignment_scores(b, score):
    assert A.align("ACGTACGTAC", b).score == score
    assert A.align_banded("ACGTACGTAC", b) == score


def plain_nw(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            m[i][j] = -3 * (i + j)
        else:
            s = 1 if a[i - 1] == b[j - 1] or "N" in (a[i - 1], b[j - 1]) else -1
            m[i][j] = max(m[i - 1][j - 1] + s, m[i - 1][j] - 3, m[i][j - 1] - 3)
    return m[-1][-1]


def test_alignment_against_plain_version():
    r = random.Random(2)
    for _ in range(60):
        a, b = ("".join(r.choices("ACGTN", k=r.randint(0, 15))) for _ in "ab")
        assert A.align(a, b).score == plain_nw(a, b)
        x, y = A.traceback(a, b)
        assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
        cost = sum(-3 if "-" in (p, q) else 1 if p == q or "N" in (p, q) else -1 for p, q in zip(x, y))
        assert cost == plain_nw(a, b)
        if abs(len(a) - len(b)) <= 3:
            assert A.align_banded(a, b, 30) == plain_nw(a, b)


def test_other_alignments():
    with pytest.raises(ValueError):
        A.align_banded("AAAAAAAA", "A", 3)
    assert A.trim_trailing_gaps("ACGTAA", "ACGT") == A.Result(4, 4, 4)
    assert A.align_free_ends("ACGT", "TTACGTTT", both=False).score == 4
    assert A.common_score("ACGT", "AGT")[0] == 3
    assert A.common_score("ACCGT", "ACGT")[1:] == A.traceback("ACCGT", "ACGT", None, 1, 0, 0)
    w, p, c = A.align_three("ACGGTACG", "ACGTACG", "ACGTACG")
    assert len(w) == len(p) == len(c)
    assert (w.replace("-", ""), p.replace("-", ""), c.replace("-", "")) == ("ACGGTACG", "ACGTACG", "ACGTACG")
    row, best, at = A.align_node("ACG", "ACGTT")
    assert (best, at) == (3, 3) and A.attainable(row) <= 3
    assert "|" in A.show("ACG", "ACG")


def test_mixture_finds_two_peaks():
    values = np.arange(1, 80)
    p = np.exp(stats.log_negative_binomial(values, 2, 3)) * 3e5 + np.exp(stats.log_negative_binomial(values, 30, 45)) * 1e5
    fit = stats.fit_mixture(values, p, [1.5, 25.0])
    assert fit[1]["mu"] == pytest.approx(30, rel=0.05)
    assert 4 < stats.coverage_cutoff(fit, 1) < 20
    assert stats.genome_size(fit, int(p.sum()), 1) == pytest.approx(1e5, rel=0.1)


def test_formats(spark):
    df = spark.createDataFrame([("A(1)A\tS(9)S\tB(0)B\tP(3 4)P\tC(1 -2 3)C", "5S20M2I3D", "*")], "i string, c string, d string")
    r = df.select(T.tag(F.col("i"), "C").alias("t"), T.chain_of(T.tag(F.col("i"), "C")).alias("x"), T.cigar_tokens(F.col("c")).alias("c"), F.size(T.cigar_tokens(F.col("d"))).alias("d"), T.cigar_supported(F.col("c"), "MSI").alias("ok")).first()
    assert (r["t"], r["x"]) == ("1 -2 3", [1, -2, 3])
    assert [(x["n"], x["op"]) for x in r["c"]] == [(5, "S"), (20, "M"), (2, "I"), (3, "D")]
    assert (r["d"], r["ok"]) == (0, False)
    assert T.human_time(3725) == "1h 2m 5s" and T.human_time(65) == "1m 5s"
    assert len(T.date_time()) > 10


def test_codes_as_plain_kmers():
    import random

    import pyarrow as pa

    from helixframe.functions import codes

    r = random.Random(1)
    texts = ["".join(r.choice("ACGTACGTACGTN") for _ in range(r.choice([0, 1, 5, 11, 12, 30, 200]))) for _ in range(50)] + [None, "ACGT" * 30]
    column, rows = pa.array(texts)[3:], texts[3:]
    bit = {"A": 8, "C": 4, "G": 2, "T": 1}
    for step, k in ((7, 1), (64, 5), (1 << 18, 11), (33, 21), (1 << 18, 31)):
        plain, masks, letters = [], [], []
        for i, t in enumerate(t or "" for t in rows):
            for p in range(len(t) - k + 1):
                w = t[p : p + k]
                if "N" in w:
                    continue
                turn = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
                turned = turn[::-1] < w[::-1]
                m = 16 * (bit.get(t[p - 1], 0) if p else 0) | (bit.get(t[p + k], 0) if p + k < len(t) else 0)
                plain.append((i, p, sum("ACGT".index(c) << 2 * j for j, c in enumerate(turn if turned else w)), turned))
                masks.append(int(f"{m:08b}"[::-1], 2) if turned else m)
                letters.append(w)
        codes.valid_starts.__defaults__ = (step,)
        assert [x for row, pos, c, t in codes.canonical_codes(column, k) for x in zip(row.tolist(), pos.tolist(), c.tolist(), t.tolist())] == plain
        assert [x for _, m in codes.neighbour_masks(column, k) for x in m.tolist()] == masks
        assert [x for _, _, t in codes.substrings(column, k) for x in t.to_pylist()] == letters
    codes.valid_starts.__defaults__ = (codes.STEP,)
