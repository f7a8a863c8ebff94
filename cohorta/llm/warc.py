"""WARC archives: a writer, and a reader that salvages what damage leaves.

Writing: each record is one gzip member. Records with equal payloads of ``MIN_REVISIT`` bytes or more
are written once as a response, by the smallest page id; the others are revisit records that refer to
it. Archives go through Spark's own text writer, so that any file system that Spark writes to will do:
a gzip member ends with the top byte of its length, which is 0 for anything below 16 MiB, so the writer's
line separator is a 0 byte and each line is a member without its last byte. Longer members get an empty
member after them, which ends so in any case.

Only digests are shuffled to find equal payloads; the pages themselves are packed where they are scanned,
and joined with the payloads that occur more than once, which are broadcast up to a checked number.

Reading: archives are read whole by Spark's binary reader, each by one task, so a new one is begun after
as many records as come to ``ARCHIVE_BYTES`` of payloads on average; none holds more than one task's pages. A member whose inflation, header, length or digest fails is quarantined: the reader
searches on for the next gzip member or ``WARC/1.`` line that begins a valid record, reports the gap's
bytes and cause, and goes on from there. Inside a member, whole records before and after a bad one are
kept; so are those that were inflated before a member breaks, if their block digest shows them right, or
before it is cut short. A record that ends exactly where such a member's bytes end is not kept.

Edge cases: a null html is an empty payload; rows that repeat a page id and its payload are all
responses if that id is the smallest; a null page id never becomes the response of others while there
is another; archives without a valid record give gaps only; an empty table gives archives without
records; other columns of ``pages`` are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

MIN_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
#: Bytes of an archive that are inflated at once.
SLICE = 1 << 16
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + b"\x00" * 8
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_NAMESPACE = uuid.UUID("6f3c0f0e-8f55-4f5c-9b6e-1d8a5c1f2b77")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. Its page id, and the payload's length, are in extension fields."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            member = _member(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to))
            out.append((member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["line"])


def _payloads(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return p.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, int]:
    """(page_id, url, html, digest, refers_to): what each page is written as; and the mean bytes of the payloads."""
    p = _payloads(pages, id_col, url_col, html_col)
    told = p.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    by = told.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    by = materialize(by.select("digest", "first", "n", "bytes"), "payloads")
    rows, size = by.agg(F.sum("n"), F.sum("bytes")).first()
    # payloads of one page refer to nothing, whatever their length
    again = by.where((F.col("n") > 1) & (F.col("bytes") >= MIN_REVISIT * F.col("n")) & F.col("first").isNotNull()).select("digest", "first")
    joined = p.join(maybe_broadcast(again, again.count()), "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")), -(-(size or 0) // (rows or 1))


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Write every row of ``pages`` as a record of the archives in ``path``."""
    planned, mean = plan(pages, **columns)
    lines = planned.mapInArrow(_lines, "line binary").select(F.col("line").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").option("maxRecordsPerFile", max(1, archive_bytes // max(mean, 1))).text(path)


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int, str]:
    """The record at ``at`` of plain WARC data: header, block, end, and what is wrong (empty if nothing)."""
    if not _VERSION.match(data, at):
        return {}, b"", at, "no version line"
    cut = data.find(b"\r\n\r\n", at)
    if cut < 0:
        return {}, b"", at, "header not ended"
    head = {}
    for line in data[at:cut].split(b"\r\n")[1:]:
        name, mark, value = line.partition(b":")
        if mark:
            head[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "surrogatepass" if b"\xed" in value else "replace")
    length = head.get("content-length", "")
    if not length.isdigit():
        return head, b"", at, "no length"
    block = data[cut + 4 : cut + 4 + int(length)]
    end = cut + 4 + int(length)
    if len(block) < int(length):
        return head, block, at, "cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return head, block, at, "length wrong"
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return head, block, at, "digest wrong"
    return head, block, end + 4, ""


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, end, header, block) and ("gap", offset, end, cause) of one archive, in order."""
    at, bad, why = 0, None, ""
    while at < len(data):
        got, end, cause = [], at, ""
        if data.startswith(_MAGIC, at):
            plain, end, cause = _inflate(data, at)
            place, fault = 0, ""
            while place < len(plain):
                head, block, after, wrong = _parse(plain, place)
                # in a damaged member, a record that ends with what was inflated is not set off from the fault
                if not wrong and not (cause and after == len(plain)) and (cause != "member broken" or head.get("warc-block-digest", "").startswith("sha256:")):
                    got.append((head, block))
                    place = after
                    continue
                fault = fault or wrong or cause
                line = _VERSION.search(plain, place + 1)
                place = line.start() if line else len(plain)
            if fault and not cause:
                # the member is whole: its bad records are its gap, and the search goes on behind it
                if bad is not None:
                    yield "gap", bad, at, why
                    bad = None
                yield "gap", at, end, fault
        elif _VERSION.match(data, at):
            head, block, end, cause = _parse(data, at)
            got = [] if cause else [(head, block)]
        else:
            cause = "no record here"
        if cause:
            # what a broken member held before its fault is kept; the search goes on after its first byte
            if bad is None:
                bad, why = at, cause
            line = _VERSION.search(data, at + 1)
            nexts = [x for x in (data.find(_MAGIC, at + 1), line.start() if line else -1) if x >= 0]
            for head, block in got:
                yield "record", at, at, head, block
            at = min(nexts, default=len(data))
            continue
        if bad is not None:
            yield "gap", bad, at, why
            bad = None
        for head, block in got:
            yield "record", at, end, head, block
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    unpack, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and place < len(data):
            out.append(unpack.decompress(data[place : place + SLICE]))
            place += SLICE
    except zlib.error:
        return _before_fault(data, at), at, "member broken"
    if not unpack.eof:
        return b"".join(out), at, "member cut short"
    return b"".join(out), min(place, len(data)) - len(unpack.unused_data), ""


def _before_fault(data: bytes, at: int) -> bytes:
    """What a broken member gives before its fault: in pieces, the last of them byte by byte."""
    unpack, out, piece = zlib.decompressobj(31), [], 4096
    while at < len(data):
        kept = unpack.copy() if piece > 1 else None
        try:
            out.append(unpack.decompress(data[at : at + piece]))
            at += piece
        except zlib.error:
            if piece == 1:
                break
            unpack, piece = kept, 1
    return b"".join(out)


READ_SCHEMA = "archive string, offset long, length long, gap string, record_type string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            size = 0
            for x in salvage(content.as_py()):
                if x[0] == "gap":
                    rows.append((path, x[1], x[2] - x[1], x[3], *[None] * 7))
                else:
                    _, start, end, head, block = x
                    kind, payload = head.get("warc-type"), block.partition(b"\r\n\r\n")[2]
                    of = lambda k: int(v) if (v := head.get(k, "")).lstrip("-").isdigit() else None
                    digest, length, gap = head.get("warc-payload-digest", "").removeprefix("sha256:"), of("x-payload-length"), None
                    if kind == "response":
                        length, found = len(payload), hashlib.sha256(payload).hexdigest()
                        gap = "payload digest wrong" if digest and digest != found else None
                        digest = found
                    rows.append((path, start, end - start, gap, kind, of("x-page"), head.get("warc-target-uri"), payload if kind == "response" else None, length, digest or None, of("x-refers-to-page")))
                    size += len(payload)
                if size >= 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives in ``path``: rows with a ``gap`` and no record type are quarantined bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, READ_SCHEMA)
