"""Media columns: payloads stored as 8-bit grey images in ZIP archives, and a Spark data source that
reads them back by byte ranges.

A payload is the text in UTF-8, padded with bytes 0 to a positive multiple of 64, and is stored as
the samples of a PNG, 64 to a row. Each writing task puts its images into archives in the shared
folder. The source plans byte ranges over the archives of a folder from their sizes alone; the task
of a range reads the archive's directory, takes the members that begin in the range, reads each by
its offset, and yields Arrow batches of bounded size. A member that cannot be read or fails its
checksum is tried again by itself, from its offset, before the task gives up.

Defined cases: a null or empty text is 64 samples of 0; equal texts give equal images and features;
repeated or null doc_ids are members of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Workspace, open_fs, publish

WIDTH = 64
_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, unpadded: int, level: int = 6) -> bytes:
    """An 8-bit grey PNG whose samples are the payload; the unpadded length is a text chunk."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % unpadded) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The payload and the unpadded length; every chunk's checksum is verified."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, parts, unpadded, size = 8, [], 0, (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt":
            unpadded = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return raw[:, 1:].tobytes(), unpadded


def features(payload: bytes) -> str:
    """Rows, mean, deviation, entropy in bits and share of equal neighbours, as one string."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    flat = float((x[1:] == x[:-1]).mean())
    return f"rows={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};entropy={-float((p * np.log2(p)).sum()) + 0.0:.4f};flat={flat:.4f}"


class ArchiveWriter:
    """A ZIP of stored members on a stream that cannot seek; sizes and offsets of 64 bits throughout."""

    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def add(self, name: str, data: bytes) -> None:
        n, crc, raw = len(data), zlib.crc32(data), name.encode()
        wide = struct.pack("<HHQQ", 1, 16, n, n)
        head = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide)) + raw + wide
        self.entries.append((raw, crc, n, self.at))
        self.out.write(head + data)
        self.at += len(head) + n

    def close(self) -> None:
        start, size = self.at, 0
        for raw, crc, n, at in self.entries:
            wide = struct.pack("<HHQQQ", 1, 24, n, n, at)
            entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + raw + wide
            self.out.write(entry)
            size += len(entry)
        end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(self.entries), len(self.entries), size, start)
        locator = struct.pack("<IIQI", 0x07064B50, 0, start + size, 1)
        self.out.write(end + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, crc, bytes, offset of the local header) of each member, from the end of the archive."""
    tail = f.read_at(min(size, 98), max(0, size - 98))
    i = tail.rfind(struct.pack("<I", 0x06064B50))
    if i < 0:
        raise ValueError("no archive directory")
    n, length, start = struct.unpack("<QQQ", tail[i + 32 : i + 56])
    raw, at, out = f.read_at(length, start), 0, []
    for _ in range(n):
        crc, name_n, extra_n = struct.unpack("<I", raw[at + 16 : at + 20])[0], *struct.unpack("<HH", raw[at + 28 : at + 32])
        name = raw[at + 46 : at + 46 + name_n].decode()
        _, _, _, stored, offset = struct.unpack("<HHQQQ", raw[at + 46 + name_n : at + 74 + name_n])
        out.append((name, crc, stored, offset))
        at += 46 + name_n + extra_n
    return out


def read_member(f, name: str, crc: int, n: int, offset: int, tries: int = 3, wait: float = 0.2) -> bytes:
    """A member's bytes by its own offset; a failed or damaged read is repeated for this member only."""
    for left in range(tries - 1, -1, -1):
        try:
            head = f.read_at(30, offset)
            skip = sum(struct.unpack("<HH", head[26:30]))
            data = f.read_at(n, offset + 30 + skip)
            if head[:4] == b"PK\x03\x04" and len(data) == n and zlib.crc32(data) == crc:
                return data
            error: Exception = ValueError(f"member {name} at {offset} is damaged")
        except OSError as e:
            error = e
        if left:
            time.sleep(wait)
    raise error


class _Range(InputPartition):
    def __init__(self, uri: str, size: int, lo: int, hi: int) -> None:
        self.uri, self.size, self.lo, self.hi = uri, size, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri, self.range_bytes, self.batch_bytes = options["path"], int(options.get("rangeBytes", 32 << 20)), int(options.get("batchBytes", 4 << 20))

    def partitions(self):
        fs, path = open_fs(self.uri)
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return [_Range("", 0, 0, 0)]
        out = []
        for f in fs.get_file_info(pafs.FileSelector(path)):
            if f.type == pafs.FileType.File and ".zip" in f.base_name:
                out += [_Range(f"{self.uri}/{f.base_name}", f.size, lo, min(f.size, lo + self.range_bytes)) for lo in range(0, f.size, self.range_bytes)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part):
        if not part.uri:
            return
        fs, path = open_fs(part.uri)
        with fs.open_input_file(path) as f:
            names, held, size = [], [], 0
            for name, crc, n, offset in directory(f, part.size):
                if part.lo <= offset < part.hi:
                    names.append(name)
                    held.append(read_member(f, name, crc, n, offset))
                    size += n
                    if size >= self.batch_bytes:
                        yield _batch(names, held)
                        names, held, size = [], [], 0
            if held:
                yield _batch(names, held)


def _batch(names: list[str], held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["name", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("assayer_archives").load(folder): (name, media) of the archives' members."""

    @classmethod
    def name(cls) -> str:
        return "assayer_archives"

    def schema(self) -> str:
        return "name string, media binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_folder(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("assayer_archives").load(uri)


def write_folder(docs: DataFrame, work: Workspace, archive_bytes: int = 128 << 20) -> str:
    """Stores each text's payload; returns a folder that holds exactly the archives of the tasks that
    committed."""
    uri = work.uri + "/archives"

    def write(stream):
        part = TaskContext.get().partitionId()
        rows = (r for batch in stream for r in batch.to_pylist())
        done, no, nxt = [], 0, next(rows, None)
        while nxt is not None:

            def fill(out):
                nonlocal nxt, no
                zipped = ArchiveWriter(out)
                while nxt is not None and zipped.at < archive_bytes:
                    raw = (nxt["text"] or "").encode()
                    payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                    zipped.add(f"{'null' if nxt['doc_id'] is None else nxt['doc_id']}/{part}-{no}.png", to_png(payload, len(raw)))
                    no += 1
                    nxt = next(rows, None)
                zipped.close()

            done.append(publish(uri, f"part-{part:06d}-{len(done):04d}.part", fill))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["uri"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    manifest = work.keep(rows.mapInArrow(write, "uri string"), "manifest")

    def commit(stream):  # only what the manifest names gets a name that the source reads
        for batch in stream:
            for u in batch.column("uri").to_pylist():
                fs, path = open_fs(u)
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.move(path, path + ".zip")
            yield pa.RecordBatch.from_arrays([batch.column("uri")], ["uri"])

    work.keep(manifest.mapInArrow(commit, "uri string"), "committed")
    return uri


def media_features(stored: DataFrame) -> DataFrame:
    """The columns of the op4 contract from (name, media) rows."""

    def read(stream):
        for batch in stream:
            rows = []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload, unpadded = from_png(data)
                ident = name.split("/")[0]
                rows.append((None if ident == "null" else int(ident), unpadded, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def store_and_read(docs: DataFrame) -> DataFrame:
    work = Workspace(docs.sparkSession, "media")
    return media_features(read_folder(docs.sparkSession, write_folder(docs, work)))
