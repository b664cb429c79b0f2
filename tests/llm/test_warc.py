import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, None, None), (3, "http://a/\n3", ""), (4, "u", "<p>one</p>"), (5, "u", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (6, "u", "é東\U0001f600" * 400), (0, "u", "<p>one</p>"), (7, "u", "\r\n\n\r"), (8, "u", "é東\U0001f600" * 400)]


def digest(text):
    raw = (text or "").encode()
    return base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw)


def want(rows, least=0):
    first = {}
    for i, _, h in rows:
        d, n = digest(h)
        if n >= least:
            first[d, n] = min(i, first.get((d, n), i))
    out = {}
    for i, _, h in rows:
        d, n = digest(h)
        f = first.get((d, n), i)
        out[i] = (n, d, "response" if f == i else "revisit", None if f == i else f)
    return out


def got(df):
    return {r["record_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


@pytest.mark.parametrize("chunk", [64, 1000, warc.CHUNK_BYTES])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, chunk, least):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("record_id", F.lit("own"))
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=least, chunk_bytes=chunk)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert got(warc.summaries(records)) == want(ROWS, least)
    bodies = {}
    for r in sorted(records.filter("record_type <> 'revisit'").collect(), key=lambda r: (r["record_id"], r["chunk"])):
        bodies[r["record_id"]] = bodies.get(r["record_id"], b"") + bytes(r["body"])
        assert len(r["body"]) <= chunk
    for i, _, h in ROWS:
        if i in bodies:
            assert bodies[i] == (h or "").encode()


def test_empty_null_and_repeated_ids(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.round_trip(none, str(tmp_path / "e")).count() == 0
    rows = [(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (None, "u", "x"), (None, None, "own"), (None, "u", "own"), (3, "u", "y"), (4, "u", "long " * 90), (None, "u", "long " * 80), (4, "u", "long " * 80)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "n"), chunk_bytes=64)
    found = warc.summaries(warc.read_archives(spark, str(tmp_path / "n"))).collect()
    made = sorted(((r["record_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found), key=str)
    want = [(1, 1, "response", None), (1, 1, "revisit", 1), (1, 1, "response", None), (0, 1, "revisit", 1), (0, 3, "response", None), (0, 3, "response", None), (3, 1, "revisit", 1), (4, 450, "response", None), (0, 400, "revisit", 4), (4, 400, "response", None)]
    assert made == sorted(want, key=str)


def test_own_names(spark, tmp_path):
    names = ["record_id", "sha", "mark_id", "mark_sha", "first_id", "refers_to", "payload_bytes", "payload_digest", "uri", "value", "rows", "n"]
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({n: F.lit("own") for n in names})
    assert got(warc.round_trip(pages, str(tmp_path / "c"))) == want(ROWS)


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_ROWS", 2)
    rows = [(i, "u", f"{i} " * 300) for i in range(60)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "b"), chunk_bytes=500)
    assert len(list((tmp_path / "b").glob("*.gz"))) > 20
    assert got(warc.summaries(warc.read_archives(spark, str(tmp_path / "b")))) == want(rows)


def test_reader_takes_any_cut():
    raw = b"".join((t + "\n").encode() for t in warc.record_rows(5, "u", "abc" * 50, digest("abc" * 50)[0], 150, None, 40))
    whole = [b for _, b in warc.Reader([raw])]
    assert [b for _, b in warc.Reader(raw[i : i + 1] for i in range(len(raw)))] == whole
    assert b"".join(whole) == b"abc" * 50
    with pytest.raises(ValueError):
        list(warc.Reader([raw[:-3]]))


def test_query(spark):
    from helixframe.llm.queries import op7_warc

    rows = [(r["page_id"], None, r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    found = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op7_warc(spark, "/root/testdata/sf0.001").collect()}
    assert found == want(rows)


def test_every_row_has_a_record(spark, tmp_path):
    """Rows that repeat id and payload: one is what a single row would be, the others revisit the response."""
    big = "long " * 90
    rows = [(5, "u", big)] * 4 + [(7, "u", big)] * 3 + [(None, "u", big)] * 2 + [(None, "u", "alone " * 50)] * 3 + [(9, "u", "q")] * 2
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "r"), chunk_bytes=64)
    records = warc.read_archives(spark, str(tmp_path / "r"))
    made = sorted(((r["record_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.summaries(records).collect()))
    want = [(5, "response", 0)] + [(5, "revisit", 5)] * 3 + [(7, "revisit", 5)] * 3 + [(0, "revisit", 5)] * 2 + [(0, "response", 0)] * 3 + [(9, "response", 0), (9, "revisit", 9)]
    assert made == sorted(want)
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "l"), chunk_bytes=64, least_bytes=1000)
    found = warc.summaries(warc.read_archives(spark, str(tmp_path / "l"))).collect()
    assert len(found) == len(rows) and {r["record_type"] for r in found} == {"response"}
