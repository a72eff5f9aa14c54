"""Documents to files of coded token ids in ascending doc_id order, and back.

Documents are dealt out by ranges of doc_id, so that the order of the files is that of the ids; each
task encodes its texts, writes files to the shared folder and reports their names as rows. These
rows are the manifest: readers go by it, so what lost or repeated attempts leave behind is never
read. All else comes from the files: their indexes say where the blocks are and how many ids each
holds, and the blocks, decoded in parallel wherever they fall, name their documents.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat a
doc_id stand together, ordered by their texts' hashes, and may be dealt to several tasks; an empty
table gives no rows and no files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, open_fs, publish
from .rans import Table, Writer, read_index
from .tokens import encoder, forget, text_batches

MANIFEST = "part int, file int, uri string"


def write_tokens(docs: DataFrame, uri: str, vocabulary: str, end_id: int = 2, file_tokens: int = 4 << 20) -> DataFrame:
    """Writes the files and returns the manifest, one row per file; a lazy table: keep it once.

    Files ordered by (part, file) hold the documents in ascending doc_id order.
    """
    end = end_id.to_bytes(4, "little")

    def write(stream):
        enc = encoder(vocabulary)
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        size = files = 0

        def flush():
            nonlocal files, size
            path = publish(uri, f"part-{part:06d}-{files:04d}.rans", lambda out: _write(out, held))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([files], pa.int32()), "uri": [path]})
            files, size = files + 1, 0
            held.clear()
            return row

        for batch in stream:
            ids = batch.column("doc_id").to_pylist()
            for at, texts in text_batches(batch.column("text")):
                for k, data in enumerate(enc.encode(texts)):
                    held.append((ids[at + k], data + end))
                    size += len(data) // 4 + 1
                if size >= file_tokens:
                    yield flush()
        if held:
            yield flush()

    # Hash and place tell the rows of one doc_id apart, so that they need not fall to one task.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"_hash": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_place")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST)


def _write(out, held) -> None:
    w = Writer(out)
    for d in held:
        w.add(*d)
    w.close()


class _Files:
    """The file read last, opened once: its index, and its blocks when asked for."""

    def __init__(self) -> None:
        self.uri = self.file = self.table = None

    def open(self, uri: str) -> dict:
        if uri != self.uri:
            self.close()
            fs, path = open_fs(uri)
            self.uri, self.file, self.table = uri, fs.open_input_file(path), None
            self.index = read_index(lambda at, n: self.file.read_at(n, at), self.file.size())
        return self.index

    def block(self, uri: str, number: int) -> tuple[list[int | None], list[int], bytes]:
        b = self.open(uri)["blocks"][number]
        if self.table is None:
            self.table = Table(self.file.read_at(self.index["head"], 0))
        return self.table.decode(self.file.read_at(b["bytes"], b["at"]), b)

    def close(self) -> None:
        if self.file:
            self.file.close()


def token_blocks(manifest: DataFrame) -> DataFrame:
    """(part, file, uri, block, n) per block, from the indexes of the manifest's files."""

    def listed(stream):
        forget()
        for batch in stream:
            files, rows = _Files(), []
            for r in batch.to_pylist():
                rows += [r | {"block": i, "n": b["n"]} for i, b in enumerate(files.open(r["uri"])["blocks"])]
            files.close()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("uri", pa.string()), ("block", pa.int32()), ("n", pa.int64())]))

    return manifest.mapInArrow(listed, MANIFEST + ", block int, n long")


def read_tokens(blocks: DataFrame, with_ids: bool = False, tasks: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document, decoded from the files' blocks (a kept
    table) in ``tasks`` tasks. ids are little-endian unsigned 32-bit integers."""
    spark = blocks.sparkSession
    # One row per part: as many as there were tasks.
    sizes = [(r["part"], r["n"], r["c"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("c")).orderBy("part").toLocalIterator()]
    base = dict(zip((p for p, _, _ in sizes), accumulate((n for _, n, _ in sizes), initial=0), strict=False))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = tasks or max(1, min(sum(c for _, _, c in sizes), most))
    w = Window.partitionBy("part").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))

    def read(stream):
        forget()  # the worker may have written before
        files = _Files()
        for batch in stream:
            for b in batch.to_pylist():
                docs, lengths, raw = files.block(b["uri"], b["block"])
                ends = list(accumulate(lengths, initial=0))
                parts = [raw[4 * x : 4 * y] for x, y in zip(ends, ends[1:], strict=False)]
                first = base[b["part"]] + b["before"]
                cols = [pa.array(docs, pa.int64()), pa.array([first + x for x in ends[:-1]], pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
        files.close()

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return blocks.repartition(tasks, "uri", "block").sortWithinPartitions("uri", "block").mapInArrow(read, out)


def store_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    work = Workspace(docs.sparkSession, "tokens")
    manifest = work.keep(write_tokens(docs, work.uri + "/files", vocabulary, end_id), "manifest")
    return read_tokens(work.keep(token_blocks(manifest), "blocks"))
