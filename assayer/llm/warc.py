"""WARC archives: pages written as records, read back with reassembly of segmented ones.

Writing: equal payloads are found by digest (a small aggregate per digest; pages themselves are never
grouped), the page with the least id keeps its payload as a response record, the others become
revisit records. Payloads are framed as chunked transfer coding; blocks over ``segment_bytes`` are cut
into a first record and continuation records. Every record is a gzip member of its own.

Reading: each task scans archives member by member. Continuations are grouped by the identifier of
their first record, ordered by segment number and checked against the total length; the HTTP head is
cut off and the chunked framing decoded. Records in one piece never leave the task that reads them.

Defined cases: a null page is an empty payload; payloads under ``least_bytes`` are always responses;
of rows that repeat a page_id with one payload all are responses if that id is the least; a null
page_id is a response and refers to nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, open_fs, publish

CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunk sizes and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + CRLF * 2) + z.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, uid: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit."""
    name = f"<urn:page:{uid}>"
    clean = "".join(c for c in url or "" if c.isprintable())
    common = [("WARC-Target-URI", clean), ("WARC-Date", _DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("X-Page", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *more], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)
        return
    cut = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for n, part in enumerate(cut, 1):
        if n == 1:
            yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", "1")], part)
        else:
            total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cut) else []
            yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{uid}:{n}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n)), ("WARC-Target-URI", clean), ("WARC-Date", _DATE), *total], part)


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    left, z, held = b"", zlib.decompressobj(31), io.BytesIO()
    while True:
        data = left or stream.read(size)
        if not data:
            if held.tell():
                raise ValueError("an archive ends inside a record")
            return
        held.write(z.decompress(data))
        left = b""
        if z.eof:
            yield held.getvalue()
            left, z, held = z.unused_data, zlib.decompressobj(31), io.BytesIO()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    end = raw.index(CRLF * 2)
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(raw) < end + 4 + n:
        raise ValueError("a record is shorter than its length says")
    return headers, raw[end + 4 : end + 4 + n]


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """Segments (number, total length or None, block) in any order to one block; repeated segments
    must be equal, all numbers from 1 must be there and the total length must hold."""
    by: dict[int, bytes] = {}
    totals = {t for _, t, _ in segments if t is not None}
    for n, _, b in segments:
        if by.setdefault(n, b) != b:
            raise ValueError("two different segments have one number")
    block = b"".join(by[n] for n in range(1, len(by) + 1)) if sorted(by) == list(range(1, len(by) + 1)) else None
    if block is None or totals != {len(block)}:
        raise ValueError("segments are missing or do not have the total length")
    return block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF * 2)
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PIECE = PAGE + ", origin string, segment int, total long, block binary"


def write_archives(pages: DataFrame, work: Workspace, segment_bytes: int = 32_768, least_bytes: int = 100, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives and returns the kept manifest (uri, records, bytes)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ids = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    ids = work.keep(ids.select("page_id", "digest"), "digests")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").select("digest", "first")
    again = ids.join(first, "digest").where("page_id > first").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first").alias("refers_to")).distinct()
    again = work.keep(again, "revisits")
    digest = F.sha2(F.col("html").cast("binary"), 256)
    todo = pages.withColumn("digest", digest)
    if again.count() <= 100_000:  # under 20 MB
        again = F.broadcast(again)
    todo = todo.join(again, (todo["page_id"] == again["_p"]) & (todo["digest"] == again["_d"]), "left").drop("_p", "_d")
    uri = work.uri + "/archives"

    def write(stream):
        part = TaskContext.get().partitionId()
        rows = (r for batch in stream for r in batch.to_pylist())
        done, n = [], 0
        nxt = next(rows, None)
        while nxt is not None:
            state = {"records": 0, "bytes": 0}

            def fill(out, state=state):
                nonlocal nxt, n
                while nxt is not None and state["bytes"] < archive_bytes:
                    for r in page_records(nxt["page_id"], nxt["url"], nxt["html"].encode(), nxt["digest"], nxt["refers_to"], f"{part}:{n}", segment_bytes):
                        out.write(r)
                        state["records"] += 1
                        state["bytes"] += len(r)
                    n += 1
                    nxt = next(rows, None)

            done.append({"uri": publish(uri, f"part-{part:06d}-{len(done):04d}.warc.gz", fill)} | state)
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("uri", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return work.keep(todo.mapInArrow(write, "uri string, records long, bytes long"), "manifest")


def _page(h: dict[str, str]) -> dict:
    number = lambda k: int(h[k]) if h.get(k) else None
    return {"page_id": number("x-page"), "url": h.get("warc-target-uri"), "payload_bytes": number("x-payload-length"), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "record_type": h["warc-type"], "refers_to": number("x-refers-to-page")}


def _check(page: dict, payload: bytes) -> dict:
    digest = hashlib.sha256(payload).hexdigest()
    if digest != page["payload_digest"] or len(payload) != page["payload_bytes"]:
        raise ValueError(f"the payload of page {page['page_id']} fails its digest")
    return page


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def read_archives(manifest: DataFrame, work: Workspace) -> DataFrame:
    """The pages as read back: payload length and digest are those of the reassembled, decoded
    payload; a revisit has those its record states."""

    def scan(stream):
        for batch in stream:
            for uri in batch.column("uri").to_pylist():
                fs, path = open_fs(uri)
                held, size = [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in members(f):
                        h, block = parse_record(raw)
                        segment = int(h.get("warc-segment-number", 0))
                        if segment:
                            origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                            total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                            held.append(_page(h) | {"origin": uri + origin, "segment": segment, "total": total, "block": block})
                            size += len(block)
                        elif h["warc-type"] == "response":
                            held.append(_check(_page(h), payload_of(block)))
                        else:
                            held.append(_page(h))
                        if len(held) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        total = [None if pd.isna(t) else int(t) for t in pdf["total"]]
        block = reassemble(list(zip(pdf["segment"].tolist(), total, pdf["block"].tolist(), strict=True)))
        first = pdf[pdf["segment"] == 1].iloc[:1]
        page = {"page_id": first["page_id"].iloc[0], "payload_digest": first["payload_digest"].iloc[0], "payload_bytes": int(first["payload_bytes"].iloc[0])}
        _check(page, payload_of(block))
        return first.drop(columns=["origin", "segment", "total", "block"])

    # A stated number of partitions: adaptive execution would merge so few bytes into one task.
    files = manifest.repartition(max(1, manifest.count()), "uri")
    pieces = work.keep(files.select("uri").mapInArrow(scan, _PIECE), "pieces")
    names = [f.split()[0] for f in PAGE.split(", ")]
    one = pieces.where("origin is null").select(*names)
    many = pieces.where("origin is not null").groupBy("origin").applyInPandas(whole, PAGE)
    return one.unionByName(many)


def archive_round_trip(pages: DataFrame, segment_bytes: int = 32_768, least_bytes: int = 100) -> DataFrame:
    work = Workspace(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, work, segment_bytes, least_bytes), work)
