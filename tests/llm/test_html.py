"""Wrapper induction against texts that are read off the test pages in another way, with regular expressions."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import html_extract
from assayer.llm.common import Workspace

SCHEMA = "page_id long, url string, html string"


def article(page):
    """The blocks of the only article element of a test page."""
    inner = re.sub(r"<br>", " ", re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.S)[1])
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|div|ul|li)>", inner)]
    return "\n\n".join(x for x in parts if x)


def bare(page):
    """The page with elements that say nothing about what they hold."""
    return re.sub(r"<(/?)(?:nav|article|footer)>", r"<\1div>", page).replace('<div class="ad">', "<div>")


def read(spark, pages, **options):
    df = spark.createDataFrame([(i, f"https://site.example/{i}", p) for i, p in enumerate(pages)], SCHEMA)
    return [r["text"] for r in html_extract.extract_pages(df, **options).orderBy("page_id").collect()]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_whole_table_equals_the_articles(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect()}
    want = {r["page_id"]: (t := article(r["html"]), len(t)) for r in pages.collect()}
    assert got == want


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_wrappers_find_the_articles_of_pages_without_telling_names(spark, most_bytes):
    """All pages of the largest table: each host has a wrapper, and without wrappers the results differ."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    df = spark.createDataFrame([(r["page_id"], r["url"], bare(r["html"])) for r in rows], SCHEMA)
    host = df.withColumn("host", html_extract.host_of(F.col("url")))
    assert html_extract.wrappers(Workspace(spark, "test"), host).count() == host.select("host").distinct().count()
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df, most_bytes=most_bytes).collect()}
    want = {r["page_id"]: article(r["html"]) for r in rows}
    assert got == want
    assert all(html_extract.extract(bare(r["html"])) != want[r["page_id"]] for r in rows)


@pytest.mark.parametrize("pages", [2, 7, 40])
def test_a_template_that_outweighs_the_articles_goes(spark, pages):
    rng = random.Random(pages)
    legal = words(rng, 120)
    bodies = [[words(rng, 12) for _ in range(rng.randint(1, 3))] for _ in range(pages)]
    made = [f"<body><div>Site</div><div><h1>{b[0][:9]}</h1>{''.join(f'<p>{x}</p>' for x in b)}</div><div><p>{legal}</p></div></body>" for b in bodies]
    assert read(spark, made) == ["\n\n".join([b[0][:9].strip(), *b]) for b in bodies]


def test_pages_of_any_length_vote_and_are_read(spark):
    rng = random.Random(4)
    long = [[words(rng, 400) for _ in range(95)] for _ in range(6)]
    made = [f"<body><div>Home of all</div><div>{''.join(f'<p>{x}</p>' for x in b)}<div>Kept for ever</div></div><div>Rights</div></body>" for b in long]
    assert min(map(len, made)) > 200_000
    assert read(spark, made) == ["\n\n".join(b) for b in long]


def test_constant_text_inside_articles_goes_but_copies_stay(spark):
    rng = random.Random(5)
    bodies = [[words(rng, 15) for _ in range(3)] for _ in range(12)]
    bodies += [bodies[0]] * 8  # copies of one article do not make it a template
    made = [f"<article><h1>{b[0]}</h1><p>{b[1]}</p><div>Tell your friends about it</div><p>{b[2]}</p></article><div>x{i} {words(rng, 3)}</div>" for i, b in enumerate(bodies)]
    assert read(spark, made) == ["\n\n".join(b) for b in bodies]
    near = [f"<article><p>{bodies[0][0]}</p><p>{bodies[0][1]} {i}</p><p>{bodies[0][2]}</p></article>" for i in range(3)]
    assert read(spark, near) == ["\n\n".join([bodies[0][0], f"{bodies[0][1]} {i}", bodies[0][2]]) for i in range(3)]


@pytest.mark.parametrize(
    "inner,kept",
    [
        ('<div class="post-header"><h1>Title</h1></div><p>Text of it.</p>', "Title\n\nText of it."), ('<p class="side-effects">It may itch.</p>', "It may itch."),
        ('<table class="nav-data"><tr><td>1</td><td>2</td></tr></table>', "1\n\n2"), ('<div class="research share"><p>Half of all the papers come from there, and two thirds of all that is cited.</p></div>', "Half of all the papers come from there, and two thirds of all that is cited."),
        ('<p>Text.</p><div class="share"><a href="x">Mail</a></div><section class="comments"><p>First!</p></section><div id="comment-list"><p>No</p></div>', "Text."),
        ('<p>Text.</p><div class="ad-slot">Buy</div><div class="mainNav">a</div><div class="cookie_notice">We use some</div><form>q</form><aside>s</aside>', "Text."),
        ('<header><h1>Title</h1></header><p hidden>no</p><p style="display: none">no</p><p>Text</p>', "Title\n\nText"),
        ('<a title="a > b" href=x>one</a> two <b title="x>three</b>', "one two three"),
    ],
)
def test_names(inner, kept):
    assert html_extract.extract(f"<body><header>Site</header><article>{inner}</article><footer>f</footer></body>") == kept


def test_odd_rows(spark):
    rows = [(1, "http://h.example/a", None), (1, "http://h.example/a", ""), (1, "http://h.example/a", "  \n"), (None, None, "<p>a</p>"), (2, "http://h.example/a", "<p>b</p>"), (2, "http://h.example/a", "<p>b</p>"), (3, "http://h.example/a", "</p></div>c<"), (4, "http://h.example/a", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame([(*r, "x", 3, "h") for r in rows], SCHEMA + ", text string, n_chars long, host string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in html_extract.extract_pages(df).collect())
    assert got == [(0, "a"), (1, ""), (1, ""), (1, ""), (2, "b"), (2, "b"), (3, "c<"), (4, "deep")]
