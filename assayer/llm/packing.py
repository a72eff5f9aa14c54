"""Best-two-fit packing of token sequences into rows of a fixed length.

Each document becomes its ids plus an end id; only documents over ``limit`` are cut, into pieces of
exactly ``limit`` and one rest. Pieces (a few integers each, no text) are dealt by a hash of their
place in the table into shards of about ``shard_rows`` pieces, and each shard is packed in one task: fill greedily
with the longest piece that fits, then swap the smallest piece of the sequence for two unpacked ones
that fill the widened gap more tightly. The least filled sequences of all shards are packed again,
so that sharding costs no rows. The number of shards grows with the data; a task never does.

Defined cases: a null or empty text is one piece that holds the end id; repeated rows and repeated
or null doc_ids are packed row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import encoder, text_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), in one pass over the texts."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(stream):
        enc = encoder(vocabulary)
        for batch in stream:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for at, texts in text_batches(batch.column("text")):
                for k, data in enumerate(enc.encode(texts)):
                    data += end
                    for p, b in enumerate(range(0, len(data), 4 * limit)):
                        part = data[b : b + 4 * limit]
                        rows.append((ids[at + k], p, b // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and offset of each length, and the fill of each sequence."""
    order = np.argsort(lengths, kind="stable")
    pool: dict[int, list[int]] = {}
    for i in order.tolist():
        pool.setdefault(int(lengths[i]), []).append(i)
    have = 0  # bit n: a piece of length n is unpacked
    for n in pool:
        have |= 1 << n
    seq, off, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []

    def longest(most: int) -> int:
        return (have & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal have
        i = pool[n].pop()
        if not pool[n]:
            have &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal have
        pool[n].append(i)
        have |= 1 << n

    while have:
        row, gap = [], limit
        while (n := longest(gap)) > 0:
            row.append((n, take(n)))
            gap -= n
        if gap and len(row) > 1:  # two for the smallest
            small, which = row[-1]
            room, best, pair = gap + small, small, None
            a = longest(room - 1)
            while a > 0 and 2 * a > best and best < room:
                b = longest(min(a, room - a))
                if b == a and len(pool[a]) < 2:
                    b = longest(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1)
            if pair:
                row.pop()
                row += [(n, take(n)) for n in pair]
                give(small, which)
                gap = room - best
        at = 0
        for n, i in row:
            seq[i], off[i] = len(fills), at
            at += n
        fills.append(at)
    return seq, off, np.array(fills, np.int64)


def _pack_shards(pieces: DataFrame, limit: int, shards: int, level: int, leave: int) -> DataFrame:
    """Packs each shard; ``left`` marks the pieces of its ``leave`` least filled sequences."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        seq, off, fills = best_two_fit(pdf["length"].to_numpy(), limit)
        worst = np.argsort(fills, kind="stable")[:leave]
        left = np.isin(seq, worst[fills[worst] < limit])
        base = (level << 60) + (int(pdf["shard"].iloc[0]) << 28)
        return pdf.drop(columns="shard").assign(sequence_id=base + seq, offset=off, left=left)

    # By the place in the kept table, as any number of rows may be equal.
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", key).groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id long, offset long, left boolean")


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = 4096, end_id: int = 1, shard_rows: int = 4000, leave: int = 3) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = work.keep(token_pieces(docs, vocabulary, limit, end_id), "pieces")
    short = pieces.where(F.col("length") < limit)
    first = work.keep(_pack_shards(short, limit, max(1, -(-short.count() // shard_rows)), 1, leave), "packed")
    rest = first.where("left").select(*pieces.columns)
    again = _pack_shards(rest, limit, max(1, -(-rest.count() // (4 * shard_rows))), 2, 0)
    full = pieces.where(F.col("length") == limit).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return first.where("not left").drop("left").unionByName(again.drop("left")).unionByName(full)
