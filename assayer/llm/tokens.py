"""Token ids by the tokenizers library, each distinct word once per worker.

The library spends most of a text on words that it has encoded before. Where a vocabulary file
describes one of two plain byte-pair encoders (byte level, or lower-cased words with an end mark),
no token spans a certain kind of cut: for words any white space, for bytes the place before a space
that follows no white space, for both the end of a run of letters. Texts are cut there, the library encodes each new part, and the ids of
short parts are kept. A text goes to the library whole where a part could be encoded otherwise
alone: it holds the string of a special token or a character on which Python and the library may
disagree about white space, or the file is of any other kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Separators that are white space to Python alone, or to some versions of Unicode alone.
_DOUBTFUL = "\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"
# White space and a space after it: the space is then cut off only where it stands alone.
_RUNS = [c + " " for c in map(chr, range(0x3001)) if c.isspace() and c not in _DOUBTFUL]
_ASCII_RUNS = [r for r in _RUNS if r.isascii()]
_CUT = re.compile(r"(?<=\S) ")
_FIRST = "\x1c"  # marks parts without a space before them
_BETWEEN = "~"  # new parts are encoded together with this between them
# No token spans the end of a run of letters, nor a single line break and a letter after it. Cut there,
# fewer parts differ. A mark after a letter may be composed with it.
_AFTER_LETTERS = r"(\pL)([^\pL\pM ])"
_AFTER_BREAK = r"([\pL\pN\pP\pS])\n(\pL)"
# Fixed value: the pattern by which the second kind of vocabulary splits a text.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _kind(spec: dict) -> str | None:
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    if spec.get("post_processor") not in (None, {}) and (spec["post_processor"] or {}).get("type") != "ByteLevel":
        return None
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not model.get("end_of_word_suffix"):
        return "bytes"
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORD_PATTERN} and not parts[1]["use_regex"] and model.get("end_of_word_suffix") == "</w>":
        return "words"
    return None


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, entries: int = 500_000, longest: int = 100) -> None:
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self._t.get_vocab_size(with_added_tokens=True)
        self._special = [x["content"] for x in spec.get("added_tokens", [])]
        self._cache: dict[str, bytes] = {}
        self._entries, self._longest = entries, longest
        # Strings of special tokens that a change of case, of composition or of spaces could make.
        plain = all(s.isascii() and not x.get("lstrip") and not x.get("rstrip") and not x.get("normalized") for x in spec.get("added_tokens", []) for s in [x["content"]])
        self.kind = _kind(spec) if plain else None
        # Per id whether it ends a word, or starts one with a space.
        self._edge = np.zeros(self.size, bool)
        for w, i in spec.get("model", {}).get("vocab", {}).items() if self.kind else ():
            self._edge[i] = w.endswith("</w>") if self.kind == "words" else w.startswith("\u0120")
        mark = self._t.encode(_BETWEEN if self.kind == "words" else " " + _BETWEEN, add_special_tokens=False).ids
        self.kind, self._between = (self.kind, mark[0]) if len(mark) == 1 else (None, 0)

    def whole(self, text: str) -> bytes:
        return np.asarray(self._t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _cut(self, text: str) -> list[str]:
        """Keys of the cache, each standing for itself with a space before it, of a text with runs of
        white space."""
        first, *rest = _CUT.split(text)
        return [_FIRST + first, *rest] if first else rest

    def _safe(self, text: str) -> bool:
        if self.kind == "words" and "\u0130" in text:  # its small form ends in a mark
            return False
        return self.kind is not None and not any(c in text for c in _DOUBTFUL) and not any(s in text for s in self._special)

    def _encoded(self, new: list[str]):
        """Batches (keys, their ids) of new parts. Most are encoded as one text and told apart by the
        first tokens of parts that start with a space, or by the last tokens of words: one of each run
        of letters and one of a mark after it. The others are encoded as one text with separators of
        one id between them; those that hold the separator or start a text, one by one."""
        told, counts, others, alone = [], [], [], []
        if self.kind == "words":
            for w in new:
                if w.isalpha():
                    told.append(w)
                    counts.append(1)
                elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                    told.append(w)
                    counts.append(2)
                else:
                    (alone if _BETWEEN in w else others).append(w)
        else:
            told = [w for w in new if w[:1] != _FIRST]
            alone = [w for w in new if w[:1] == _FIRST] if len(told) < len(new) else []
        space = "" if self.kind == "words" else " "
        for a in range(0, len(told), 512):
            some = told[a : a + 512]
            ids = np.array(self._t.encode_batch_fast([space + " ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self._edge[ids])
            marks = np.cumsum(counts[a : a + 512]) if counts else None
            if len(at) != (marks[-1] if counts else len(some)):  # letters or spaces to Python only
                alone += some
                continue
            at = [0, *(4 * (at[marks - 1] + 1)).tolist()] if counts else [*(4 * at).tolist(), 4 * len(ids)]
            if at[0] or at[-1] != 4 * len(ids):
                alone += some
                continue
            data = ids.tobytes()
            yield some, [data[x:y] for x, y in zip(at, at[1:], strict=False)]
        for a in range(0, len(others), 512):
            some = others[a : a + 512]
            ids = np.array(self._t.encode_batch_fast([f" {_BETWEEN} ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self._between).tolist(), len(ids)]
            data = ids.tobytes()
            yield some, [data[4 * x : 4 * y] for x, y in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
        for a in range(0, len(alone), 512):
            some = alone[a : a + 512]
            texts = [w[1:] if w[:1] == _FIRST else space + w for w in some]
            yield some, [array("I", e.ids).tobytes() for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, runs = [], []
        for i, t in enumerate(texts):
            if not self._safe(t):
                out[i] = self.whole(t)
            elif self.kind == "words":
                plain.append((i, t.lower() if t.isascii() else t))
            elif t and _has_runs(t):
                runs.append((i, self._cut(t)))
            elif t:
                plain.append((i, t[1:] if t[0] == " " else _FIRST + t))
        if not plain and not runs:
            return out
        cut = pa.array([t for _, t in plain], pa.large_string())
        if self.kind == "words":
            cut = pc.utf8_split_whitespace(pc.replace_substring_regex(cut, _AFTER_LETTERS, r"\1 \2"))
        else:
            cut = pc.replace_substring_regex(cut, _AFTER_BREAK, "\\1\n " + _FIRST + "\\2")
            cut = pc.split_pattern(pc.replace_substring_regex(cut, _AFTER_LETTERS, "\\1 " + _FIRST + "\\2"), " ")
        cut = pa.concat_arrays([cut, pa.array([p for _, p in runs], cut.type)])
        coded = cut.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # The ids of all parts in a row: from where each distinct part's ids stand.
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        data = flat[np.repeat(first[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        for (i, _), x, y in zip([*plain, *runs], bounds.tolist(), bounds[1:].tolist(), strict=False):
            out[i] = data[x:y].tobytes()
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        cache = self._cache
        ids = list(map(cache.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = [words[i] for i in missing]
            for keys, found in self._encoded([w for w in new if w] if self.kind == "words" else new):
                cache.update(zip(keys, found, strict=True))
            for i, w in zip(missing, new, strict=True):
                ids[i] = cache.get(w, b"")
            for w in new:
                if len(w) > self._longest:
                    del cache[w]
        if len(cache) > self._entries:  # the parts met first are the common ones: keep those
            for w in list(islice(cache, self._entries // 2, None)):
                del cache[w]
        return ids


def _has_runs(text: str) -> bool:
    for r in _ASCII_RUNS if text.isascii() else _RUNS:
        if r in text:
            return True
    return False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Gives back the memory of this worker's encoders."""
    _ENCODERS.clear()


def text_batches(column, rows: int = 1024, chars: int = 2 << 20):
    """(start, texts) slices of an Arrow string column with bounded text; nulls are empty."""
    start, held, size = 0, [], 0
    for i, v in enumerate(column):
        t = v.as_py() or ""
        held.append(t)
        size += len(t)
        if len(held) >= rows or size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
