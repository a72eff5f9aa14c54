"""The operators against brute force, on the smallest tables and on a table of odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import html_extract, jaccard_join, license_scan, media, mixing, packing, pii, quality, rans, token_files, warc
from assayer.llm.common import Workspace
from assayer.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, pii string, Q_n_words long, kept string"
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "single", "en", "", 6), (5, COPY, "en", "a", 1), (6, COPY, "en", "b", 1), (6, COPY, "en", "b", 1),
    (7, COPY + "end", "en", "b", 1), (8, "MIT License and mit license! cc by, CC-BY gnu general public license", "en", "b", 1), (None, "no id here mail me at a@b.co or +49 (30) 1234567", None, "c", 1),
    (9, "x" * 70000 + "@" + "1" * 5000 + "...", "en", "c", 1), (10, "été 中文 \U0001f600 ½ İ a_b  c\n\n\n d\r\n", "zz", "é", 1), (11, "word " * 30000, "en", "a", 1),
    (12, "4111 1111 1111 1111 and 10.0.0.255 or 1.2.3.4.5 or 300.1.1.1 GB82 WEST 1234 5698 7654 32 bank", "en", "a", 1), (12, "another text with the same id as before", "en", "a", 1), (-5, "negative id", "en", "d", 1), (13, "hello <|endoftext|> world <|startoftext|>", "en", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 99, "clash", 7, "no") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "docs", "empty"])
def table(request, odd, docs):
    return {"odd": odd, "docs": docs, "empty": odd.limit(0)}[request.param]


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_spans(text):
    luhn = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], ["email", "ip", "card", "phone"].index(x[0])))


def test_pii_base_spans(table):
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.detect(table)).collect())
    want = Counter()
    for i, t in rows(table):
        # Before the @ stand 70,000 letters, from each of which the pattern would be tried.
        s = brute_spans(t) if "@" not in t or len(t) < 50_000 else [(k, a + 69_990, b + 69_990) for k, a, b in brute_spans(t[69_990:])]
        c = Counter(k for k, *_ in s)
        want[(i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert got == want


def test_pii_random_strings_match_the_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("ab@.-+ 0123456789()%,") for _ in range(rng.randint(1, 60)))
        assert [x[:3] for x in pii.find(t) if x[0] in pii.BASE_KINDS] == brute_spans(t), t


def test_pii_replaces_a_column_of_its_name(odd):
    got = sorted((r["text"] or "", len(r["pii"]), r["size"]) for r in pii.detect(odd, replace=True).where("doc_id in (1, 12)").collect())
    assert got == [("", 0, 99), ("<card> and <ip> or <ip>.5 or 300.1.1.1 <iban> bank", 4, 99), ("another text with the same id as before", 0, 99)]


def test_pii_checksums_context_and_redaction():
    t = "IBAN GB82 WEST 1234 5698 7654 32 but not GB82 WEST 1234 5698 7654 33; mail x@y.org"
    found = pii.find(t)
    assert [k for k, *_ in found] == ["iban", "email"] and found[0][3] == 1.0
    assert pii.redact(t, found).startswith("IBAN <iban> but not GB82") and pii.redact(t, found).endswith("<email>")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_packing_is_whole_gapless_and_tight(table):
    got = packing.pack_documents(table, WORD, limit=64).collect()
    want = Counter()
    for i, t in rows(table):
        ids = library_ids(WORD, t) + b"\1\0\0\0"
        for p in range(0, len(ids), 256):
            part = ids[p : p + 256]
            want[(i, p // 256, p // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 64) * 1.05 + 2


def test_packing_deals_equal_rows_to_many_shards(spark):
    df = spark.createDataFrame([(None, "same text")] * 900, "doc_id long, text string")
    got = packing.pack_documents(df, WORD, limit=64, shard_rows=100).collect()
    assert len(got) == 900 and len({r["sequence_id"] >> 28 for r in got}) > 5


def test_best_two_fit_swaps_the_smallest():
    seq, off, fills = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert sorted(fills.tolist()) == [30, 100] and len(seq) == len(off) == 4


def test_token_files_round_trip(table):
    got = token_files.store_and_read(table, BYTE).collect()
    want = Counter((i, len(d := library_ids(BYTE, t) + b"\2\0\0\0") // 4, zlib.crc32(d)) for i, t in rows(table))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at, last = 0, float("-inf")
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["doc_id"] if r["doc_id"] is not None else float("-inf")) >= last
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last


def test_token_files_of_one_id_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame([(None, f"text {i % 7}") for i in range(400)] + [(3, "x")], "doc_id long, text string").repartition(4)
    work = Workspace(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = work.keep(token_files.write_tokens(df, work.uri + "/files", BYTE, file_tokens=100), "m")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = work.keep(token_files.token_blocks(manifest), "b")
    assert manifest.select("part").distinct().count() > 1 and manifest.count() == blocks.count()
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], bytes(r["ids"])) for r in token_files.read_tokens(blocks, with_ids=True, tasks=3).collect())
    assert Counter(x[3] for x in got) == Counter(library_ids(BYTE, t) + b"\2\0\0\0" for t in [f"text {i % 7}" for i in range(400)] + ["x"])
    assert [x[0] for x in got] == [sum(y[1] for y in got[:k]) for k in range(401)] and got[-1][2] == 3


@pytest.mark.parametrize("n,alphabet", [(0, 5), (1, 1), (5, 1), (1000, 1), (5000, 3), (70_000, 50_000)])
def test_rans_blocks(n, alphabet):
    import io

    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % alphabet).astype("<u4")
    out = io.BytesIO()
    w = rans.Writer(out, block_tokens=1 << 12)
    cut = np.array_split(ids, 7)
    for i, c in enumerate(cut):
        w.add(i, c.tobytes())
    w.close()
    data = out.getvalue()
    index = rans.read_index(lambda at, k: data[at : at + k], len(data))
    table = rans.Table(data[: index["head"]])
    back = [table.decode(data[b["at"] : b["at"] + b["bytes"]], b) for b in index["blocks"]]
    assert b"".join(x[2] for x in back) == ids.tobytes()
    assert [d for x in back for d in x[0]] == list(range(7)) and [k for x in back for k in x[1]] == [len(c) for c in cut]
    if n:
        b = index["blocks"][0]
        bad = bytearray(data[b["at"] : b["at"] + b["bytes"]])
        bad[0] ^= 1
        with pytest.raises(ValueError):
            table.decode(bytes(bad), b)


def library_ids(path, text):
    ids = Tokenizer.from_file(path) if path not in _LIBRARY else _LIBRARY[path]
    return np.array(_LIBRARY.setdefault(path, ids).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_LIBRARY = {}


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path, small):
    rng = random.Random(3)
    pool = list("abcXYZ \n\t'.,!1éß½中_İΣς") + ["  ", " ", "n't", "'s", " the", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|", "~", " ~ ", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "e\u0301", "\u0301", "\U0001f600", "\u180e", "x" * 120]
    e = Encoder(path, entries=50)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["hello <|endoftext|> world", "a \n  b", " \n \n c ", "\n\n  x", ""]
    texts += [r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    for a in range(0, len(texts), 100):
        assert e.encode(texts[a : a + 100]) == [library_ids(path, t) for t in texts[a : a + 100]]
    assert e.kind


def test_media_round_trip(table):
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in media.store_and_read(table).collect())
    want = Counter()
    for i, t in rows(table):
        raw = t.encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[(i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert got == want


def test_media_member_retries_by_offset():
    class Flaky:
        def __init__(self, data):
            self.data, self.left = data, 2

        def read_at(self, n, at):
            if self.left:
                self.left -= 1
                raise OSError("gone")
            return self.data[at : at + n]

    import io
    import zipfile

    out = io.BytesIO()
    z = media.ArchiveWriter(out)
    z.add("a", b"abc")
    z.add("b", b"defg")
    z.close()
    data = out.getvalue()
    assert zipfile.ZipFile(io.BytesIO(data)).read("b") == b"defg"
    f = Flaky(data)
    f.left = 0
    entries = media.directory(f, len(data))
    f.left = 2
    assert media.read_member(f, *entries[1], wait=0) == b"defg"


def test_license_base_and_method(table):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in rows(table):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        at, names = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hit = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hit
            names |= {label} if hit else set()
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)))] += 1
    got = license_scan.scan(table).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_diagonals_survive_edits(spark):
    notice = license_scan.TEMPLATES["mit-notice"].split()
    edited = " ".join(w for i, w in enumerate(notice) if i != 25)
    df = spark.createDataFrame([(1, "intro words " + edited + " tail"), (2, " ".join(reversed(notice)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert "mit-notice" in got[1]["labels"] and got[1]["score"] > 0.8 and got[2]["labels"] == ""


def brute_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines, dup, seen = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = set()
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            mark |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(mark)


def test_quality_statistics_and_base(table):
    judged = quality.judge(table, quality.DecisionList())
    got = Counter((r["doc_id"], *[r[f"q_{c}"] for c in quality.BASE], r["base_failed"]) for r in judged.collect())
    assert set(table.columns) - {"Q_n_words", "kept"} <= set(judged.columns) and judged.columns.count("q_n_words") == 1
    want = Counter()
    for i, t in rows(table):
        s = brute_quality(t)
        want[(i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0])] += 1
    assert got == want


def test_quality_keeps_columns_of_other_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, "y")], "doc_id long, text string, q_note string, _q_w int, q_N_words string")
    got = quality.judge(df, quality.DecisionList()).collect()[0]
    assert (got["q_note"], got["_q_w"], got["q_n_words"], got["kept"]) == ("x", 2, 2, False)


def test_quality_learns_and_prunes(docs, spark, small):
    rng = random.Random(1)
    data = [{n: rng.random() for n in quality.STATISTICS} for _ in range(600)]
    for r in data:
        r["bad"] = r["symbol_share"] > 0.7 and r["digit_share"] > 0.5
    rules = quality.learn(data)
    hit = [any(x.covers(r) for x in rules.rules) for r in data]
    assert rules.rules and sum(h and r["bad"] for h, r in zip(hit, data, strict=True)) > 0.8 * sum(r["bad"] for r in data)
    assert sum(h and not r["bad"] for h, r in zip(hit, data, strict=True)) <= 3
    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id")
    assert judged.where("kept and quality = 1").count() >= 0.95 * judged.where("quality = 1 and not base_failed").count()
    assert quality.fit(docs, labels.limit(0)).rules == ()


def test_mixing_targets(table):
    got = mixing.mix(table).select("doc_id", "source", "text", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(table).select("doc_id", "text", "taken").collect()
    assert Counter((r["doc_id"], r["text"], r["taken"]) for r in got) == Counter(tuple(r) for r in again)
    assert len(got) == table.count()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if level[s] > 2 * sizes[s]}
        if not full:
            target |= level
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    taken, largest = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 0.05 * target[s]) for s in target)
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6) and r["taken"] <= 2 * r["size"]


def brute_components(data, k, percent):
    sets = []
    for i, t in data:
        w = t.encode().lower().split()
        sets.append((i, {tuple(w[j : j + min(k, len(w))]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (x, (i, a)), (y, (j, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(x)] = find(y)
    best = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            best[find(x)] = min(best.get(find(x), i), i)
    return Counter((i, len(s), best.get(find(x)) if i is not None else None) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(table, k, percent):
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(table, k, percent).collect())
    assert got == brute_components(rows(table), k, percent)


def test_jaccard_near_copies_in_blocks(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
        texts.append((i, " ".join(t)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85, block_nodes=20).collect())
    assert got == brute_components(texts, 4, 85)
    kept = jaccard_join.keep_one_of_each(df, 4, 85)
    assert kept.count() == len({c for _, _, c in got})


PAGES = [
    (1, "http://h.example/a", "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>f</footer></body></html>"),
    (2, "http://h.example/b", None), (3, None, ""), (4, "no url", "<p>a<script>if (a</b) x()</script> b</p><!-- c --><form>no</form><aside>no</aside><div id=comments>no</div>"), (4, "no url", "<p>a"),
    (5, "http://h.example/c", "plain < text &lt;b&gt; &nbsp; end"), (None, "http://h.example/d", "<ul><li>x<li>y</ul>" + "<div>" * 3000 + "deep"),
]


def test_html_blocks(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in PAGES], "page_id long, url string, html string, text string, n_chars long")
    got = {(r["page_id"], r["url"], r["text"]) for r in html_extract.extract_pages(df).collect()}
    want = {(1, "http://h.example/a", "A & B\n\none two three\n\nfour"), (2, "http://h.example/b", ""), (3, None, ""), (4, "no url", "a b"), (4, "no url", "a"), (5, "http://h.example/c", "plain < text <b> end"), (None, "http://h.example/d", "x\n\ny\n\ndeep")}
    assert got == want
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_html_wrapper_drops_what_a_host_repeats(spark, most_bytes):
    page = "<html><body><div>Site name</div><div><p>story {i} of its own length {i}</p><p>more {i}{i}</p></div><div>All rights kept</div></body></html>"
    df = spark.createDataFrame([(i, f"https://site.example/{i}", page.format(i=i)) for i in range(20)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, most_bytes=most_bytes).collect()}
    assert got == {i: f"story {i} of its own length {i}\n\nmore {i}{i}" for i in range(20)}


def test_warc_round_trip(spark, small):
    odd = [*PAGES, (9, "http://a/\n", "z" * 150), (8, "http://b", "z" * 150), (8, "http://b", "z" * 150), (11, "c", "long " * 40_000), (12, "c", "long " * 40_000), (13, "d", "short"), (14, "d", "short")]
    for df in (spark.createDataFrame(odd, "page_id long, url string, html string"), spark.read.parquet(f"{small}/pages.parquet")):
        got = Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.archive_round_trip(df, segment_bytes=4096).collect())
        data = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
        first = {}
        for i, p in data:
            if i is not None and len(p) >= 100:
                first[p] = min(first.get(p, i), i)
        want = Counter()
        for i, p in data:
            ref = first.get(p)
            again = i is not None and ref is not None and ref < i
            want[(i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", ref if again else None)] += 1
        assert got == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_segments_and_chunks():
    body = bytes(range(256)) * 50
    assert warc.unchunk(warc.chunked(body, 100)) == body
    assert warc.reassemble([(2, 6, b"def"), (1, None, b"abc"), (2, 6, b"def")]) == b"abcdef"
    for bad in ([(1, None, b"abc")], [(2, 3, b"abc")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 5, b"b")]):
        with pytest.raises(ValueError):
            warc.reassemble(bad)


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    work = Workspace(spark, "test")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(work.keep(stage(spark, seen[-1], small), "s"))
    assert all(set(s.columns) >= set(docs.columns) for s in seen[:-1])
    clean, one, private, mixed, packed = seen[1:]
    ok = {r["doc_id"] for r in clean.collect()}
    assert all(brute_quality(t)[0] >= 20 for _, t in rows(clean))
    comps = brute_components(rows(clean), 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in comps} and {i for i, *_ in comps} == ok
    assert sum(len(brute_spans(t)) for _, t in rows(private)) == 0 and private.count() == one.count()
    assert mixed.select("doc_id").distinct().count() <= private.count() and mixed.count() > private.count()
    assert packed.select("sequence_id", "offset").distinct().count() == packed.count()
    assert packed.where("piece = 0").count() == mixed.count()
    assert corpus_pipeline.ORACLE_SQL is None and F is not None
