"""Documents to chunks: one Arrow pass per document, rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_words(text: str, most_bytes: int) -> list[str]:
    """Words packed greedily with single spaces up to ``most_bytes`` bytes; a longer word stands alone."""
    out, held, size = [], [], 0
    for w in text.split():
        n = len(w.encode())
        if held and size + 1 + n > most_bytes:
            out.append(" ".join(held))
            held, size = [], 0
        size += n + bool(held)
        held.append(w)
    return [*out, " ".join(held)] if held else out


def split_at_headlines(text: str, headlines: list[str], least: int = 0, most: int = 0) -> list[str]:
    """Cut where each headline first occurs; short pieces join the next, long ones are cut by words."""
    cuts = sorted({0, *(p for h in headlines if h and (p := text.find(h)) >= 0)})
    pieces = [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    pieces = [p for p in pieces if p]
    if len(text) < least or len(pieces) <= 1:
        return [text]
    out: list[str] = []
    for p in pieces:
        while most and len(p) > most:
            at = p.rfind(" ", 0, most)
            at = at if at > 0 else most
            out.append(p[:at].strip())
            p = p[at:].strip()
        if out and (len(out[-1]) < least or len(p) < least) and (not most or len(out[-1]) + 1 + len(p) <= most):
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


_CHUNK = pa.schema([("id", pa.string()), ("source_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string())])


def cut_documents(stream: Iterator[pa.RecordBatch], most_bytes: int, held_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of (key, text), given back whenever they have ``held_bytes`` characters or one
    document has more: beside Arrow's batch no more than that is held, however long the texts are."""
    rows: list[tuple] = []
    size = 0
    for batch in stream:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            k = str(key.as_py())
            found = pack_words(text.as_py() or "", most_bytes)
            rows += [(f"{k}-chunk-{i}", k, i, c) for i, c in enumerate(found)]
            size += sum(map(len, found))
            if size >= held_bytes:
                yield _chunk_batch(rows)
                rows, size = [], 0
        if rows:
            yield _chunk_batch(rows)
            rows, size = [], 0
        batch = key = text = None  # else they are held while the next one is read
        pa.default_memory_pool().release_unused()


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK, strict=True)], schema=_CHUNK)


def chunk_documents(docs: DataFrame, most_bytes: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source_id, chunk_index, text) per chunk; a blank or null text has none."""
    kept = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return kept.mapInArrow(lambda stream: cut_documents(stream, most_bytes), "id string, source_id string, chunk_index int, text string")
