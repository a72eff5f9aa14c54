"""Token ids in files coded by a static range asymmetric numeral system.

A file holds the documents of one task: a frequency table shared by its blocks, then blocks that can
be decoded alone, then an index. A block codes whole documents with interleaved lanes: token t is
coded by lane t mod lanes, all lanes advance together, and the words that the lanes emit at a step
lie together, so decoding is vectorised too. Each block carries its documents' ids and lengths and
the lanes' final states (its checkpoint); the index gives every block's place, size, and checksums of
its coded and decoded bytes, so blocks decode in parallel and a bad block is found by itself.

File: magic, table (symbols and frequencies, zlib), blocks, index (JSON, zlib), length of the index,
magic. Block: length of its list of documents, that list (JSON, zlib), coded words. All integers are
little-endian.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RANSTOK1"
PROB_BITS = 20
LOW = np.uint64(1 << 31)


def frequency_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, and their frequencies: at least 1 each, 2**PROB_BITS in all."""
    symbols = np.flatnonzero(counts)
    if not len(symbols):
        return symbols.astype("<u4"), symbols.astype("<u4")
    total = 1 << PROB_BITS
    if len(symbols) > total:
        raise ValueError("more symbols than the table has places")
    c = counts[symbols].astype(np.float64)
    freq = np.maximum(1, np.floor(c * (total / c.sum()))).astype(np.int64)
    gap = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if gap > 0:
        freq[order[0]] += gap
    while gap < 0:
        cut = min(int(freq[order[0]] - 1) // 2 + 1, -gap)
        freq[order[0]] -= cut
        gap += cut
        order = np.argsort(-freq, kind="stable")
    return symbols.astype("<u4"), freq.astype("<u4")


def encode_block(ids: np.ndarray, starts: np.ndarray, freqs: np.ndarray, lanes: int) -> bytes:
    """The coded words of ids; starts and freqs are indexed by id."""
    n = len(ids)
    state = np.full(lanes, LOW, np.uint64)
    out = []
    start, freq = starts[ids], freqs[ids]
    steps = -(-n // lanes)
    bits, word = np.uint64(PROB_BITS), np.uint64(32)
    top = np.uint64(63 - PROB_BITS)
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        spill = x >= (f << top)
        if spill.any():
            out.append((x[spill] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(spill, x >> word, x)
        q = x // f
        state[: b - a] = (q << bits) + (x - q * f) + start[a:b]
    out.reverse()
    words = np.concatenate(out) if out else np.zeros(0, "<u4")
    return state.astype("<u8").tobytes() + words.astype("<u4").tobytes()


def decode_block(data: bytes, n: int, lanes: int, symbol: np.ndarray, starts: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """The ids; symbol is indexed by place in the table, starts and freqs by rank of the symbol."""
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * lanes)
    out = np.empty(n, np.uint32)
    mask, bits, word = np.uint64((1 << PROB_BITS) - 1), np.uint64(PROB_BITS), np.uint64(32)
    at = 0
    for a in range(0, n, lanes):
        k = min(lanes, n - a)
        x = state[:k]
        slot = x & mask
        r = symbol[slot]
        out[a : a + k] = r
        x = freqs[r] * (x >> bits) + slot - starts[r]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << word) | words[at : at + len(low)]
            at += len(low)
        state[:k] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a coded block does not end in the first state")
    return out


class Writer:
    """Writes one file: documents are buffered, then coded with the table of all of them."""

    def __init__(self, out, block_tokens: int = 1 << 17, most_lanes: int = 2048) -> None:
        self.out, self.block_tokens, self.most_lanes = out, block_tokens, most_lanes
        self.docs: list[tuple[int | None, bytes]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, ids))

    def close(self) -> dict:
        """Returns the index, with the place of each block."""
        counts = np.zeros(1, np.int64)
        for _, ids in self.docs:
            c = np.bincount(np.frombuffer(ids, "<u4"))
            if len(c) > len(counts):
                c[: len(counts)] += counts
                counts = c
            else:
                counts[: len(c)] += c
        symbols, freq = frequency_table(counts)
        packed = zlib.compress(symbols.tobytes() + freq.tobytes())
        head = MAGIC + struct.pack("<II", len(symbols), len(packed)) + packed
        self.out.write(head)
        starts, freqs = np.zeros(len(counts), np.uint64), np.ones(len(counts), np.uint64)
        starts[symbols] = np.concatenate([[0], np.cumsum(freq.astype(np.int64))[:-1]]).astype(np.uint64) if len(symbols) else []
        freqs[symbols] = freq
        at, blocks = len(head), []
        for docs in self._blocks():
            raw = b"".join(ids for _, ids in docs)
            ids = np.frombuffer(raw, "<u4")
            lanes = max(1, min(self.most_lanes, len(ids) // 32))
            listed = zlib.compress(json.dumps([[d for d, _ in docs], [len(x) // 4 for _, x in docs]]).encode())
            data = struct.pack("<I", len(listed)) + listed + encode_block(ids, starts, freqs, lanes)
            blocks.append({"at": at, "bytes": len(data), "n": len(ids), "lanes": lanes, "crc": zlib.crc32(data), "ids_crc": zlib.crc32(raw)})
            self.out.write(data)
            at += len(data)
        index = {"head": len(head), "blocks": blocks}
        packed = zlib.compress(json.dumps(index).encode())
        self.out.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        return index

    def _blocks(self) -> Iterator[list[tuple[int | None, bytes]]]:
        held, size = [], 0
        for d in self.docs:
            held.append(d)
            size += len(d[1]) // 4
            if size >= self.block_tokens:
                yield held
                held, size = [], 0
        if held:
            yield held


class Table:
    """A file's frequency table, ready for decoding."""

    def __init__(self, head: bytes) -> None:
        if head[:8] != MAGIC:
            raise ValueError("not a file of coded tokens")
        n, size = struct.unpack("<II", head[8:16])
        raw = zlib.decompress(head[16 : 16 + size])
        self.symbols = np.frombuffer(raw, "<u4", n)
        freq = np.frombuffer(raw, "<u4", n, 4 * n)
        self.freqs = freq.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(freq.astype(np.int64))[:-1]]).astype(np.uint64)
        self.rank = np.repeat(np.arange(n, dtype=np.uint32), freq)

    def decode(self, data: bytes, block: dict) -> tuple[list[int | None], list[int], bytes]:
        """(ids of the documents, their lengths, their tokens one after the other) of a block, which
        the index describes."""
        if zlib.crc32(data) != block["crc"]:
            raise ValueError("a coded block fails its checksum")
        size = struct.unpack("<I", data[:4])[0]
        docs, lengths = json.loads(zlib.decompress(data[4 : 4 + size]))
        raw = self.symbols[decode_block(data[4 + size :], block["n"], block["lanes"], self.rank, self.starts, self.freqs)].tobytes()
        if zlib.crc32(raw) != block["ids_crc"] or 4 * sum(lengths) != len(raw):
            raise ValueError("a decoded block fails its checksum")
        return docs, lengths, raw


def read_index(read_at, size: int) -> dict:
    """The index of a file of ``size`` bytes, given read_at(offset, length)."""
    tail = read_at(size - 16, 16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of coded tokens")
    n = struct.unpack("<Q", tail[:8])[0]
    return json.loads(zlib.decompress(read_at(size - 16 - n, n)))
