from collections import defaultdict

from helixframe.llm import line_dedup as ld

from .util import AWKWARD, clashing, documents, empty, real_texts


def brute(rows, least=10):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ld.line_key(line)
            if len(k) >= least:
                holders[k].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := ld.line_key(x)) >= least and len(holders[k]) > 1 and min(holders[k]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def check(spark, rows, wrap=lambda d: d):
    got = ld.drop_repeated_lines(wrap(documents(spark, rows)), details=True).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_lines"], r["n_dropped"], r["text"] or "") == want[r["doc_id"]]


def test_awkward(spark):
    check(spark, AWKWARD, clashing)


def test_real(spark):
    check(spark, real_texts(1000))


def test_hot_line_in_any_order(spark, monkeypatch):
    rows = [(i * 7919 % 997, f"the line that all documents hold\nown line number {i}") for i in range(997)]
    check(spark, rows)
    check(spark, sorted(rows, reverse=True))
    monkeypatch.setattr(ld, "HELD_KEYS", 5)
    check(spark, rows)


def test_empty_and_repeats(spark):
    assert ld.drop_repeated_lines(empty(spark)).count() == 0
    twice = [(1, "a repeated line here"), (1, "a repeated line here"), (2, "a repeated line here"), (None, "own line of nobody")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in ld.drop_repeated_lines(documents(spark, twice)).collect())
    assert got == [(0, "own line of nobody"), (1, "a repeated line here"), (1, "a repeated line here"), (2, "")]


def test_bitmaps_round_trip(spark):
    rows = [(1, "same long line\nb\nsame long line"), (2, "same long line\nc")]
    maps = {r["doc"]: r for r in ld.keep_bitmaps(documents(spark, rows)).collect()}
    assert ld.apply_bitmap(rows[0][1], bytes(maps[1]["keep"])) == rows[0][1]
    assert ld.apply_bitmap(rows[1][1], bytes(maps[2]["keep"])) == "c"


def test_hot_line_in_descending_order(spark):
    rows = [(i, "the line that all documents hold") for i in range(3000, 0, -1)]
    found = ld.keep_bitmaps(documents(spark, rows).coalesce(1))
    assert {(r["doc"], r["n_dropped"]) for r in found.collect()} == {(i, int(i > 1)) for i in range(1, 3001)}


def test_own_names(spark):
    from pyspark.sql import functions as F

    names = ["keep__", "mark__", "doc__", "map_mark__", "n_lines__", "_hkeep", "_hmark", "_hdoc", "mark", "keep", "lines", "pos"]
    df = documents(spark).withColumns({n: F.lit("own") for n in names})
    got = ld.drop_repeated_lines(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == {i: t for i, (_, _, t) in brute(AWKWARD).items()}
    named = documents(spark).withColumn("N_LINES", F.lit(7))
    assert ld.drop_repeated_lines(named, details=True).columns[-2:] == ["n_lines", "n_dropped"]
