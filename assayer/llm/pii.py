"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; a
match that fails its check is dropped without another try. Further kinds are proposed by patterns of
their own and kept from a score of ``threshold``: the pattern's prior, raised by a passed checksum
(mod 97 for account numbers, group rules for social security numbers) and by context words within
``window`` characters before the match. Every scan is linear in the text: runs that cannot hold a
match are never tried from each of their characters.

Defined cases: a null or empty text has no spans; texts are used whole; repeated rows each get their
row; an empty table gives no rows; columns named like those added are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The order of kinds in digests, and the base patterns' parts.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "mac", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
_WORD = re.compile(r"[A-Za-z0-9]")
# Characters of an account number by country, as registered.
_LENGTHS = {
    k: n
    for n, ks in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in ks.split()
}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abp]-[A-Za-z0-9-]{10,80})(?![A-Za-z0-9_])")
# Context words per kind, lower case.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "mac": ("mac", "address", "device"),
    "secret": ("key", "token", "secret", "password"),
}
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "ssn": 0.5, "mac": 0.7, "secret": 0.9}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    s = account.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The local part reaches left from the @ as far as its characters go, but not into the match
    before: the same matches as the pattern, found from the @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1  # no local part reaches over an @
        at = text.find("@", done)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    if "." not in text:
        return []
    out = []
    for m in _IP.finditer(text):  # a match never starts inside a run of digits, so none is tried there
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            out.append(m.span())
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length; where that is not known, up to the last end of a
    group that passes. What follows a number, in capitals or digits, is not taken into it."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.end()
        known, n = _LENGTHS.get(m[1]), 4
        ends = []
        for i in range(m.end(), m.end(2)):
            n += text[i] != " "
            if n == (known or n) and text[i] != " " and not _WORD.match(text, i + 1):
                ends.append(i + 1)
        for e in reversed(ends):
            if mod97(text[m.start() : e]):
                out.append((m.start(), e))
                at = e
                break
    return out


def _further(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, checksum's part of the score) for the added kinds."""
    out = [("iban", *x, 0.5) for x in ibans(text)]
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                out.append(("ssn", *m.span(), 0.1))
    if ":" in text or "-" in text:
        out += [("mac", *m.span(), 0.0) for m in _MAC.finditer(text)]
    out += [("secret", *m.span(), 0.0) for m in _SECRET.finditer(text)]
    return out


def find(text: str, threshold: float = 0.6, window: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    if not text:
        return []
    found = [(k, a, b, 0.3 if k == "card" else 0.0) for k, f in zip(BASE_KINDS, (emails, ips, cards, phones), strict=True) for a, b in f(text)]
    found += _further(text)
    out = []
    for kind, a, b, checked in found:
        near = set(re.findall(r"[a-z-]+", text[max(0, a - window) : a].lower()))
        score = min(1.0, _PRIOR[kind] + checked + (0.2 if near.intersection(CONTEXT[kind]) else 0.0))
        if kind in BASE_KINDS or score >= threshold:
            out.append((kind, a, b, round(score, 3)))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[1], rank[x[0]], x[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, threshold: float = 0.6, replace: bool = False) -> DataFrame:
    """Every row with ``pii``, its spans; with replace, ``text`` has them replaced as well."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "pii"])
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", pii {SPAN}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(stream):
        for batch in stream:
            at = batch.schema.get_field_index("text")
            texts = [v.as_py() for v in batch.column(at)]
            spans = [find(t or "", threshold) for t in texts]
            cols = batch.columns
            if replace:
                cols[at] = pa.array([redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
            named = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(named, kind)], [*batch.schema.names, "pii"])

    return docs.mapInArrow(scan, schema)


def digest(spans: DataFrame) -> DataFrame:
    """The columns of the op2 contract from a table with ``pii``."""
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("pii")).alias("spans"))

