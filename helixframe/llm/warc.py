"""WARC archives written from and read back into a chunked record table (operator 7).

Method: a payload becomes rows of record identifier and chunk number, each of bounded
size, with a digest carried from chunk to chunk.  In the archive, chunk 0 is the
record itself and later chunks are WARC continuation segments, so no reader or writer
ever holds a whole oversized record.  Archives are gzip files of bounded size that Spark's own
writer puts in the shared folder, and Spark's own reader streams them back in pieces; equal
payloads are stored once and revisited.  A record's name holds its page id and payload digest, and
a number of its own where rows repeat both.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, tuned

CHUNK_BYTES = 256 << 10
#: Bytes of records in one row of the writer, and rows in one archive: 64 MB before compression, and a chunk more a row.
BLOCK_BYTES, FILE_ROWS = 1 << 20, 64
VERSION = "WARC/1.1"
_ID = re.compile(r"urn:helixframe:page:(-?\d+|null):([A-Z2-7]{32})(?::copy:(\d+))?")

RECORDS = "record_id long, copy long, chunk long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, body binary, last boolean"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunks(text: str | None, size: int = CHUNK_BYTES):
    """(bytes, last) pieces of a text's UTF-8, each of ``size`` bytes at most, cut between code points."""
    text = text or ""
    if len(text) * 4 <= size:
        yield text.encode("utf-8", "surrogatepass"), True
        return
    step = max(1, size // 4)
    for at in range(0, len(text), step):
        yield text[at : at + step].encode("utf-8", "surrogatepass"), at + step >= len(text)


def _urn(page: int | None, digest: str, copy: int = 0) -> str:
    return f"urn:helixframe:page:{'null' if page is None else page}:{digest}" + (f":copy:{copy}" if copy else "")


def _head(kind: str, name: str, fields: list[tuple[str, str]], length: int) -> str:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"{k}: {v}" for k, v in fields] + ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def _clean(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def record_rows(page: int | None, uri: str | None, html: str | None, digest: str, size: int, refers_to: int | None, copy: int = 0, chunk_bytes: int = CHUNK_BYTES):
    """The record's segments as archive text, each without its last line feed."""
    name = _urn(page, digest, copy)
    uri_field = [("WARC-Target-URI", _clean(uri))] if uri else []
    if refers_to is not None:
        fields = [*uri_field, ("WARC-Refers-To", f"<{_urn(refers_to, digest)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
        yield _head("revisit", name, fields, 0) + "\r\n\r"
        return
    for number, (piece, last) in enumerate(chunks(html, chunk_bytes)):
        body = piece.decode("utf-8", "surrogatepass")
        segment = [] if last and not number else [("WARC-Segment-Number", str(number + 1))]
        if number:
            fields = [*segment, ("WARC-Segment-Origin-ID", f"<{name}>")] + ([("WARC-Segment-Total-Length", str(size))] if last else [])
            yield _head("continuation", f"{name}:segment:{number + 1}", fields, len(piece)) + body + "\r\n\r"
        else:
            yield _head("response", name, [*uri_field, *segment, ("WARC-Payload-Digest", f"sha1:{digest}")], len(piece)) + body + "\r\n\r"


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one WARC record per row (and its segments) to gzip files below ``path``.

    Of records with equal payloads of ``least_bytes`` or more, the smallest id is the response and
    the others revisit it.  Null payloads are empty; null urls have no target.  Rows that repeat an
    id each get a record: with the same payload, one of them is the response (or revisit) that a single row would be
    and the others revisit the response, be it their own page's.  Null ids are one page without a
    number: its rows revisit any page that has one, are responses where there is none, and nothing
    revisits them.  An empty table writes archives without records.
    """
    html = F.coalesce(F.col(html_column), F.lit(""))
    source = pages.select(F.col(id_column).cast("long").alias("record_id"), F.col(url_column).alias("uri"), html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("payload_bytes"), F.lit(0).cast("long").alias("copy"))
    # pre-aggregated, so a payload that many pages share costs a row per task
    digests = lambda df: df.groupBy("record_id", "sha").agg(F.min("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("rows"), F.min("copy").alias("first_copy"))
    own = stored(digests(source), "digests")
    if not own.filter("rows > 1").limit(1).isEmpty():  # rows that repeat id and payload are told apart by a number
        source = stored(source.withColumn("copy", F.monotonically_increasing_id()), "numbered")
        own = stored(digests(source), "digests")
    first = stored(own.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first_id is not null").select("sha", "first_id"), "first-pages")
    marks = own.join(first, "sha", "left").select(F.col("record_id").alias("mark_id"), F.col("sha").alias("mark_sha"), "first_id", "first_copy", "rows")

    def run(source):
        for b in source:
            rows: list[str] = []
            held: list[str] = []
            size = total = 0
            for page, uri, html, sha, payload_bytes, refers_to, copy in zip(*(b.column(i).to_pylist() for i in range(7))):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                for row in record_rows(page, uri, html, digest, payload_bytes, refers_to, copy, chunk_bytes):
                    held.append(row)
                    size += len(row)
                    if size >= BLOCK_BYTES:
                        rows.append("\n".join(held))
                        total += size
                        held, size = [], 0
                    if total > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                        rows, total = [], 0
            if held:
                rows.append("\n".join(held))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])

    both = source.join(marks, source["record_id"].eqNullSafe(marks["mark_id"]) & (source["sha"] == marks["mark_sha"]))
    earlier = F.col("record_id").isNull() | (F.col("first_id") < F.col("record_id"))
    repeated = (F.col("copy") != F.col("first_copy")) & (F.col("payload_bytes") >= least_bytes)
    refers_to = F.when(earlier, F.col("first_id")).when(repeated, F.col("record_id"))
    number = F.when(F.col("copy") == F.col("first_copy"), 0).otherwise(F.col("copy") + 1)  # the others' names end in theirs
    rows = both.select("record_id", "uri", "html", "sha", "payload_bytes", refers_to.alias("refers_to"), number.alias("copy"))
    rows.mapInArrow(run, "value string").write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


class Reader:
    """Parses an archive from a byte stream without holding more than a segment of it."""

    def __init__(self, source):
        self.source, self.held = iter(source), bytearray()

    def _more(self) -> bool:
        piece = next(self.source, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def _until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def _take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def __iter__(self):
        while (head := self._until(b"\r\n\r\n")) is not None:
            version, *lines = head.decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a record: {version[:40]}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            body = self._take(int(fields["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record's end is missing")
            yield fields, body


def read_archives(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The chunked record table of all gzip archives below ``path`` (see RECORDS), a row per segment.

    An archive streams through its task line by line, in order, as gzip files are never split.  A
    record in one segment has its digest and length computed here from the bytes read; segments of
    larger ones carry their bytes on.  Without ``bodies``, single segments' bytes are left out once
    they are digested.
    """

    def run(source):
        rows, held = [], 0
        for fields, body in Reader(b"\n".join(b.column(0).to_pylist()) + b"\n" for b in source if b.num_rows):
            row = _row(fields, body)
            if not bodies and row[6] is not None:
                row = (*row[:8], None, row[9])
            rows.append(row)
            held += 200 + len(row[8] or b"")
            if held > 4 << 20:
                yield _table(rows)
                rows, held = [], 0
        if rows:
            yield _table(rows)

    lines = tuned(spark).read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, RECORDS)


def _row(fields: dict, body: bytes) -> tuple:
    origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
    page, name_digest, copy = _ID.search(origin).groups()
    copy = int(copy or 0)
    record = None if page == "null" else int(page)
    segment = int(fields.get("warc-segment-number", 0))
    kind = fields["warc-type"]
    refers = _ID.search(fields.get("warc-refers-to", ""))
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or name_digest
    if kind == "revisit":
        return record, copy, 0, kind, int(refers[1]), fields.get("warc-target-uri"), int(fields["x-payload-length"]), stated, None, True
    if not segment:
        found = sha1_base32(body)
        if stated and stated != found:
            raise ValueError(f"record {record}: its payload does not have the stated digest")
        return record, copy, 0, kind, None, fields.get("warc-target-uri"), len(body), found, body, True
    return record, copy, segment - 1, kind, None, fields.get("warc-target-uri"), None, stated, body, "warc-segment-total-length" in fields


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = ["record_id", "copy", "chunk", "record_type", "refers_to", "target_uri", "payload_bytes", "payload_digest", "body", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def summaries(records: DataFrame) -> DataFrame:
    """``record_id, payload_bytes, payload_digest, record_type, refers_to`` per record.

    Segments of oversized records stream by record and chunk number through one running digest.
    """
    names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = records.filter("payload_bytes is not null").select(*names)
    schema = "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def stream(source):
        record, sha, n, stated = None, None, 0, None
        for b in source:
            done = []
            for r, copy, chunk, digest, body, last in zip(*(b.column(i).to_pylist() for i in range(6))):
                if chunk == 0:
                    record, sha, n, stated = (r, copy), hashlib.sha1(), 0, digest
                elif ((r, copy), digest) != (record, stated):
                    raise ValueError(f"record {r}: its first chunk is missing")
                sha.update(body)
                n += len(body)
                if last:
                    found = base64.b32encode(sha.digest()).decode()
                    if found != stated:
                        raise ValueError(f"record {r}: its chunks do not have the stated digest")
                    done.append((r, n, found, "response", None))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])], names=names)

    large = records.filter("payload_bytes is null").select("record_id", "copy", "chunk", "payload_digest", "body", "last")
    streamed = large.repartition("record_id", "copy", "payload_digest").sortWithinPartitions("record_id", "copy", "payload_digest", "chunk").mapInArrow(stream, schema)
    return whole.unionByName(streamed)


def round_trip(pages: DataFrame, path: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives, read them back and summarise each record; see :func:`write_archives` for nulls and repeats."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, id_column, url_column, html_column, least_bytes)
    return summaries(read_archives(spark, path, bodies=False))
