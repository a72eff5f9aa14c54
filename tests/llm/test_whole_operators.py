"""Whole jobs of the training-data operators: what a cut, a switch or a key by id would lose."""

import random
import time

import pytest

from assayer.llm import html_extract, jaccard_join, pii
from assayer.llm.common import Workspace


def texts_of(spark, pages, **kw):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, **kw).collect()}


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_html_template_longer_than_the_articles(spark, most_bytes):
    legal = "Terms that every page of this site repeats. " * 20
    page = "<html><body><div>Site name</div><div><p>story {i}</p></div><div>{legal}</div></body></html>"
    pages = [(i, f"https://s.example/{i}", page.format(i=i, legal=legal)) for i in range(12)]
    assert texts_of(spark, pages, most_bytes=most_bytes) == {i: f"story {i}" for i in range(12)}


def test_html_copies_of_a_page_are_no_template(spark):
    page = "<html><body><div>Site name</div><div><p>the same story</p></div></body></html>"
    assert set(texts_of(spark, [(i, f"https://s.example/{i}", page.replace("<p>", f"<p title='{i}'>")) for i in range(20)]).values()) == {"Site name\n\nthe same story"}
    other = "<html><body><div>Site name</div><div><p>story {i}</p></div></body></html>"
    pages = [(i, f"https://s.example/{i}", page) for i in range(200)] + [(i, f"https://s.example/{i}", other.format(i=i)) for i in range(200, 212)]
    assert texts_of(spark, pages) == {i: "the same story" if i < 200 else f"story {i}" for i in range(212)}


def test_html_long_pages_have_a_wrapper(spark):
    page = "<html><body><div>Site name</div><div><p>{i} {long}</p></div></body></html>"
    got = texts_of(spark, [(i, f"https://s.example/{i}", page.format(i=i, long="word " * 50_000)) for i in range(9)])
    assert not any("Site name" in t for t in got.values())


def test_html_aligns_all_children():
    rng = random.Random(5)
    names = ["p", "div", "table", "pre"]
    kids = [rng.choice(names) for _ in range(300)]
    a = html_extract.parse("<h1>x</h1>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(kids)) + "<h2>y</h2>")
    b = html_extract.parse("<h3>z</h3>" + "".join(f"<{t}>{i}</{t}>" for i, t in enumerate(kids) if i % 50) + "<h4>w</h4>")
    got = {(html_extract.own_text(x), html_extract.own_text(y)) for x, y in html_extract.align(a, b)}
    assert sum(x == y != "" for x, y in got) >= 0.9 * 294
    wide = html_extract.parse("<h1>x</h1>" + "<p>a</p>" * 20_000 + "<h2>y</h2>")
    assert len(html_extract.align(wide, html_extract.parse("<h3>z</h3>" + "<p>a</p>" * 20_000))) == 20_001


def test_jaccard_keeps_one_row_of_each_text_group(spark):
    words = lambda n: " ".join(f"{n}{i}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    docs = [(1, a), (5, a + " end"), (5, b), (7, b), (8, b + " end"), (9, c), (9, c), (9, words("d")), (10, ""), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.keep_one_of_each(df, 5, 80).collect())
    assert kept == [(0, a), (1, a), (5, b), (9, c), (9, words("d")), (10, "")]


def test_pii_account_numbers_end_where_their_country_says():
    number = "DE89370400440532013000"
    for t in ("IBAN DE89370400440532013000 BIC COBADEFF", "DE89 3704 0044 0532 0130 00 EUR 50", "DE89370400440532013000 5 days", "AB12 DE89370400440532013000", number + " " + number):
        got = [t[a:b].replace(" ", "") for k, a, b, _ in pii.find(t) if k == "iban"]
        assert got == [number] * t.replace(" ", "").count(number), t
    assert not any(k == "iban" for k, *_ in pii.find(number + "5"))
    check = next(f"{i:02}" for i in range(2, 99) if pii.mod97(f"ZZ{i:02}12345678901234"))  # a country without a known length
    assert pii.ibans(f"ZZ{check} 1234 5678 9012 34 PAID") == [(0, 22)]


def test_jaccard_counts_links(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = [(None, " ".join(base)), (900, ""), (901, "alone here")]
    for i in range(80):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(t)))
    sets = [(i, set(zip(*(t.split()[j:] for j in range(4)), strict=False))) for i, t in docs if i is not None and i < 900]
    want = {i: sum(100 * len(x & y) >= 85 * len(x | y) for j, y in sets if j != i) for i, x in sets} | {900: 0, 901: 0, None: None}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for nodes in (20, 1200):
        got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_components(df, 4, 85, block_nodes=nodes, links=True).collect()}
        assert got == want


def test_kept_tables_leave_no_shuffle_files(spark):
    work = Workspace(spark, "test")
    disk = spark._jsc.sc().env().blockManager().diskBlockManager()
    held = lambda: {f for f in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if f.startswith("shuffle_")}
    before = held()
    t = work.keep(spark.range(1000).repartition(3, "id"))
    end = time.time() + 10
    while held() - before and time.time() < end:
        time.sleep(0.2)
    assert not held() - before
    assert t.count() == 1000


def test_jaccard_shuffles_whole_sets_once(spark, monkeypatch):
    plans, keep = {}, Workspace.keep

    def seen(self, df, name="t"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Workspace, "keep", seen)
    base = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(base)), (2, " ".join(base + ["end"])), (2, " ".join(base)), (3, "alone here with five words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, 57, 1), (2, 57, 1), (2, 58, 1), (3, 2, 3)]
    assert plans["sets"].count("Exchange hashpartitioning") == 2  # of the sets and of the nodes alive
