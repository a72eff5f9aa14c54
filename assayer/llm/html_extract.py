"""Main text of web pages by wrapper induction.

Pages are parsed into light trees of elements. For each host two pages, those with the least and the
greatest hash of their place, are exemplars; every other page of the host, of any length, is aligned
to both by simple tree matching, and each task sums per exemplar node how often it was matched, how
often with the same text, how often with other children, and how much text, in links and outside,
differed there. These sums (a few numbers per node of an exemplar) are the host's wrapper:

* the path leads from the root to the slot that holds most of the text that varies (the content);
* slots beside the path are left out where their text is constant, mostly links, or stands in the
  same short shape on nearly all pages (menus, adverts, footers, whatever their elements are called);
  varying headings stay, as do varying slots whose shape differs from page to page;
* inside the content, nodes whose text is constant for every exemplar are template too.

A page is read off by aligning it to an exemplar. What names itself a menu, advert, form, comments and
so on is left out as well; a page whose host has no second page, or that does not align, is read by
these names and by a sole ``article`` or ``main`` element alone. No task holds a host: pages stay where
they are read.

Among fewer than ``many`` pages constant nodes of the content are template only while they make up at
most half of it, as two pages may be near copies of each other.

Defined cases: a null, empty or blank page has an empty text; pages with a null url or without a host
form no host; repeated rows each get their row and count as one page; unclosed and stray tags are
tolerated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][A-Za-z0-9:-]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^>]*+>)", re.S
)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, raw-text elements, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Elements that are never main text, those that hold others, and titles.
DROP = frozenset("head nav aside footer form button label dialog menu".split())
HOLDERS = frozenset("#root html body div main article section center table tbody tr td span header".split())
LISTS = frozenset("ul ol dl".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Words by which classes, ids and roles say that an element is no main text, and words that may stand
# beside them in a compound; a soft word counts only where the element holds little but links.
SHUN = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion replies respond sidebar signup sponsor sponsored sponsors submenu subscribe subscription widget widgets".split()
)
SOFT = frozenset("form hidden legal login overlay recommendations recommended related search share sharing social tags toolbar".split())
BESIDE = frozenset("area bar block bottom box button buttons col column container content div first footer global group holder inner item items last left link links list main navbar outer page panel primary region right rail secondary section site skip slot sub text thread top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


class Node:
    """An element: kids are elements and the texts between them, els the elements alone."""

    __slots__ = ("els", "hint", "kids", "no", "tag")

    def __init__(self, tag: str, hint: str = "") -> None:
        self.tag, self.hint, self.kids, self.els, self.no = tag, hint, [], [], 0


@lru_cache(4096)
def _attributes(raw: str) -> str:
    """Class and id as one string; that of an element which is not shown, or whose role says that it
    is no main text, is a zero byte."""
    hint = []
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "role" and value.lower() in ROLES:
            return "\0"
        if name in ("class", "id"):
            hint.append(value)
    return " ".join(hint)


@lru_cache(4096)
def shuns(hint: str) -> int:
    """2 if a name in hint says that the element is no main text, 1 if a soft one does, else 0."""
    found = 0
    for name in hint.split():
        parts = [p.rstrip("0123456789").lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name)]
        parts = [p for p in parts if p]
        if all(p in SHUN or p in SOFT or p in BESIDE for p in parts):
            found = max(found, 2 if any(p in SHUN for p in parts) else int(any(p in SOFT for p in parts)))
    return found


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at, n, low, search = [root], 0, len(page), None, _TOKEN.search
    while m := search(page, at):
        top = stack[-1]
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if top.tag == tag:
                if len(stack) > 1:
                    stack.pop()
            elif any(x.tag == tag for x in stack):
                above = _above(stack, tag)
                if tag not in BLOCK or all(x.tag not in ("article", "main", "section", "div", "body") for x in above):
                    del stack[len(stack) - len(above) - 1 :]
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
                low = low if len(low) == n else page
            end = low.find(f"</{tag}", at)
            if end >= 0:
                at = page.find(">", end) + 1 or n
            elif tag in ("script", "style", "textarea", "title", "iframe", "template"):
                at = n
            continue
        if tag in ("li", "dd", "dt", "tr", "td", "th"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table"):
                    break
        elif tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "section", "div", "main", "body", "table", "td", "li", "blockquote"):
                    break
        rest = m[3]
        node = Node(tag, _attributes(rest) if rest and _TELLING.search(rest) else "")
        top = stack[-1]
        top.kids.append(node)
        top.els.append(node)
        if tag not in VOID and not (rest and rest[-1] == "/"):
            stack.append(node)
    if at < n:
        stack[-1].kids.append(page[at:])
    return root


def _above(stack: list[Node], tag: str) -> list[Node]:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            return stack[i + 1 :]
    return []


def number(root: Node) -> list[Node]:
    """Numbers the elements in page order and lists them."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.no = len(out)
        out.append(x)
        todo += reversed(x.els)
    return out


def own_text(node: Node) -> str:
    return "".join([k for k in node.kids if type(k) is str]).strip()


def texts_of(order: list[Node], skip: frozenset[int] | set[int] = frozenset()) -> tuple[list[int], list[int]]:
    """Per numbered node the characters in its subtree outside links and in links; the own texts of
    the nodes in skip do not count."""
    prose, links = [0] * len(order), [0] * len(order)
    for x in reversed(order):
        if x.no not in skip:
            prose[x.no] += sum([len(k.strip()) for k in x.kids if type(k) is str])
        for k in x.els:
            prose[x.no] += prose[k.no]
            links[x.no] += links[k.no]
        if x.tag == "a":
            prose[x.no], links[x.no] = 0, links[x.no] + prose[x.no]
    return prose, links


def dropped(node: Node, inside: bool) -> bool:
    """Whether the element's own name says that it is not main text; inside: within an article."""
    if node.tag in DROP or node.hint == "\0" or node.tag == "header" and not inside:
        return True
    if not node.hint or node.tag in ("html", "body", "article", "main"):
        return False
    s = shuns(node.hint)
    if s == 1:
        prose, links = weigh(node)
        return links >= prose or prose < 60
    return s == 2


def weigh(node: Node) -> tuple[int, int]:
    """The characters of a subtree outside links and in links."""
    n, todo = [0, 0], [(node, node.tag == "a")]
    while todo:
        x, link = todo.pop()
        n[link] += sum([len(k.strip()) for k in x.kids if type(k) is str])
        todo += [(k, link or k.tag == "a") for k in x.els]
    return n[0], n[1]


def align(a: Node, b: Node, enters=None, wide: int = 40) -> list[tuple[Node, Node]]:
    """Pairs of nodes matched by simple tree matching: equal roots, then the best order-preserving
    matching of their children, level by level. Runs of like-named children are matched one to one
    from the front and the back; between them all children are compared, in lists longer than
    ``wide`` each with those ``wide`` places around its own, so that the cost stays linear in the page.
    With enters only the children of b's nodes numbered in it are matched."""
    out, todo = [], [(a, b)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        ks, ls = pair[0].els, pair[1].els
        if not ks or not ls or enters is not None and pair[1].no not in enters:
            continue
        n, m = len(ks), len(ls)
        front, most = 0, min(n, m)
        while front < most and ks[front].tag == ls[front].tag and ks[front].hint == ls[front].hint:
            front += 1
        todo += zip(ks[:front], ls[:front], strict=True)
        if front == most:
            continue
        back = 0
        while back < most - front and ks[n - 1 - back].tag == ls[m - 1 - back].tag and ks[n - 1 - back].hint == ls[m - 1 - back].hint:
            back += 1
            todo.append((ks[n - back], ls[m - back]))
        if front + back < most:
            todo += _matched(ks[front : n - back], ls[front : m - back], wide)
    return out


def _matched(ks: list[Node], ls: list[Node], wide: int) -> list[tuple[Node, Node]]:
    same = lambda k, q: k.tag == q.tag and (k.hint == q.hint or not k.hint or not q.hint)
    size = lambda k, q: 1 + min(len(k.kids), len(q.kids))
    # Row i of best starts at column low[i]: the whole row of a short list, else a band.
    n, m = len(ks), len(ls)
    band = m if max(n, m) <= wide else wide + m // n + 1
    low = [max(0, i * m // n - band) for i in range(n + 1)]
    best = [[0] * (min(m, i * m // n + band) - low[i] + 1) for i in range(n + 1)]

    def at(i: int, j: int) -> int:
        j = max(j - low[i], 0)
        return best[i][j] if j < len(best[i]) else 0

    for i in range(n - 1, -1, -1):
        row, lo, k, last = best[i], low[i], ks[i], 0
        down = best[i + 1][:1] * (low[i + 1] - lo) + best[i + 1] + [0]  # the row below from column lo on
        for c in range(len(row) - 1, -1, -1):
            last = max(last, down[c])
            if c + lo < m and same(k, ls[c + lo]):
                last = max(last, down[c + 1] + size(k, ls[c + lo]))
            row[c] = last
    out, i, j = [], 0, 0
    while i < n and j < m:
        if same(ks[i], ls[j]) and at(i, j) == at(i + 1, j + 1) + size(ks[i], ls[j]):
            out.append((ks[i], ls[j]))
            i, j = i + 1, j + 1
        elif at(i, j) == at(i + 1, j):
            i += 1
        else:
            j += 1
    return out


class Wrapper:
    """What a host's pages show about one of them.

    path: the nodes from the root to the content, which is its last; stays: kept slots beside it, lead:
    what lies between the path and them; gone: slots at the content's top that are left out; same:
    subtrees of constant text in the content.
    """

    def __init__(self, tree: Node, path: list[int], stays: list[int], gone: list[int], same: list[int]) -> None:
        order = number(tree)
        self.tree, self.content, self.stays, self.gone = tree, path[-1] if path else -1, frozenset(stays), frozenset(gone)
        self.same = {n: subtree_text(order[n]) for n in same}
        up = {k.no: x.no for x in order for k in x.els}
        self.lead = set(path[:-1])
        for n in stays:
            while (n := up.get(n, -1)) >= 0:
                self.lead.add(n)
        # Pages are aligned down to what decides about them.
        inner = {m.no for m in _below(order[self.content])} if same else {self.content} if gone else set()
        self.enters = self.lead | inner

    def read(self, root: Node) -> tuple[list[tuple[Node, bool]], set[int], set[int]] | None:
        """Of a page the parts that hold the content, each with whether it is within an article, and
        the numbers of its slots that are left out and of its nodes of constant text; None where the
        page has no such content."""
        if self.content < 0:
            return None
        pairs = align(root, self.tree, self.enters)
        to = {x.no: y.no for x, y in pairs}
        if self.content not in to.values():
            return None
        parts, todo = [], [(root, False)]
        while todo:
            x, within = todo.pop()
            y = to.get(x.no, -1)
            if y == self.content or y in self.stays:
                parts.append((x, within))
            elif y in self.lead:
                within = within or x.tag in ("article", "main")
                todo += [(k, within) for k in reversed(x.els)]
        same = {x.no for x, y in pairs if y.no in self.same and subtree_text(x) == self.same[y.no]}
        return parts, {x.no for x, y in pairs if y.no in self.gone}, same


def subtree_text(node: Node) -> str:
    return " ".join([t for x in _below(node) if (t := own_text(x))])


VOTES = ("seen", "same", "vary", "prose", "links")


def vote(tree: Node, texts: list[str], root: Node, nodes: list[Node]):
    """(node, VOTES...) of the exemplar's nodes that a page has."""
    pairs = align(root, tree)
    equal = {x.no for x, y in pairs if texts[y.no] and own_text(x) == texts[y.no]}
    prose, links = texts_of(nodes, equal)
    for x, y in pairs:
        ks, ls = x.els, y.els
        vary = len(ks) != len(ls) or bool(ks) and [k.tag for k in ks] != [q.tag for q in ls]
        yield y.no, 1, x.no in equal, vary, prose[x.no], links[x.no]


def induce(tree: Node, votes: dict[int, tuple[int, int, int, int, int]], share: float = 0.9, many: int = 8) -> tuple[list[int], list[int], list[int], list[int]]:
    """(path, stays, gone, same) of an exemplar from the sums of VOTES of the other pages."""
    order = number(tree)
    texts = [own_text(x) for x in order]
    none = (0, 0, 0, 0, 0)
    pages = votes.get(0, none)[0]
    if not pages:
        return [], [], [], []
    if not votes[0][3]:  # nothing varies: all pages are copies
        return [], [], [], []
    seen, same, vary, prose, links = zip(*[votes.get(x.no, none) for x in order], strict=True)
    constant = [bool(texts[x.no]) and seen[x.no] > 0 and same[x.no] >= share * seen[x.no] for x in order]
    # Subtrees that stand on nearly all pages in one shape.
    firm = [False] * len(order)
    for x in reversed(order):
        firm[x.no] = seen[x.no] >= share * pages and vary[x.no] <= (1 - share) * seen[x.no] and all(firm[k.no] for k in x.els)
    # Subtrees of which nothing varies.
    solid, any_text = [False] * len(order), [bool(t) for t in texts]
    for x in reversed(order):
        any_text[x.no] = any_text[x.no] or any(any_text[k.no] for k in x.els)
        solid[x.no] = any_text[x.no] and seen[x.no] > 0 and (constant[x.no] or not texts[x.no]) and all(solid[k.no] or not any_text[k.no] for k in x.els)
    path, x = [], tree
    while True:
        path.append(x.no)
        kids = [k for k in x.els if k.tag in HOLDERS and not (dropped(k, True) and k.tag != "header")]
        best = max(kids, key=lambda k: prose[k.no], default=None)
        if best is None or 2 * prose[best.no] < prose[x.no] or not prose[best.no]:
            break
        x = best
    content = path[-1]

    def off(k: Node, within: bool) -> bool:
        """Whether a slot beside the path, or at the content's top, is no main text."""
        if dropped(k, within or k.tag == "header"):
            return True
        if k.tag in HEADINGS or k.tag == "p":
            return solid[k.no]
        if solid[k.no] or k.tag in ("div", "section") and links[k.no] > 3 * prose[k.no] or not within and links[k.no] > prose[k.no]:
            return True
        return not within and k.tag in HOLDERS | LISTS and firm[k.no] and 4 * prose[k.no] < prose[content]

    stays, gone, within = [], [], False
    for no in path:
        x = order[no]
        within = within or x.tag in ("article", "main")
        for k in x.els:
            if k.no in path:
                continue
            out = off(k, within)
            if no == content:  # what is constant there is decided below
                gone += [k.no] * (out and not solid[k.no])
            elif not out and (within or k.tag != "header"):
                stays.append(k.no)
            elif k.tag in HOLDERS and not dropped(k, True):  # of a slot that is left out, only headings that vary
                stays += [y.no for y in _below(k) if y.tag == "h1" and prose[y.no]]
    inner = _below(order[content])[1:]
    same_nodes = [x.no for x in inner if solid[x.no]]
    if pages < many:
        own = [len(t) for t in texts]
        if 2 * sum(own[x.no] for x in inner if constant[x.no]) > sum(own[x.no] for x in inner):
            same_nodes = []
    return path, stays, gone, same_nodes


def _below(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.els
    return out


def blocks(parts: list[tuple[Node, bool]], leave: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The texts of the parts' blocks in page order; nodes in leave, and those that name themselves
    something else, are left out. A part comes with whether it is within an article."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        t = "".join(run)
        run.clear()
        t = _SPACE.sub(" ", _html.unescape(t) if "&" in t else t).strip()
        if t:
            out.append(t)

    todo: list = list(reversed(parts))
    while todo:
        x, within = todo.pop()
        if x is None:
            close()
        elif type(x) is str:
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.no not in leave and not dropped(x, within):
            if x.tag in BLOCK:
                close()
                todo.append((None, False))
            within = within or x.tag in ("article", "main")
            todo += [(k, within) for k in reversed(x.kids)]
    close()
    return out


def _main(root: Node) -> Node:
    """The element that holds the article: a sole article or main element, or all."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                found.append(x)
            elif not dropped(x, True):
                todo += x.els
        if len(found) == 1:
            return found[0]
    return root


def extract(page: str | None, wrappers: list[Wrapper] = ()) -> str:
    """The main text of a page, given the wrappers of its host. What is constant for one exemplar but
    not for the other is no template, but the text of a page that many pages copy."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    number(root)
    first, same = None, None
    for w in wrappers:
        found = w.read(root)
        if found:
            first = first or found
            same = found[2] if same is None else same & found[2]
            if not same:
                break
    if first:
        # Where all is constant, most pages of the host are copies of this one.
        return "\n\n".join(blocks(first[0], first[1] | same) or blocks(first[0], first[1]))
    top = _main(root)
    return "\n\n".join(blocks([(top, False)]))


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


_WRAPPER = "ex:int,sample:string,path:array<int>,stays:array<int>,gone:array<int>,same:array<int>"
SAMPLES = f"array<struct<{_WRAPPER}>>"
_SALTS = 16
_ID = ("page_id", "url")


class _Table:
    """Per host its exemplars, ready for use: from a broadcast table where all of them are small enough
    for one, else from the row, to which a salted join has brought them."""

    def __init__(self, table, make) -> None:
        self.table, self.make, self.cache = table, make, {}

    def of(self, host: str, row) -> list:
        if host not in self.cache:
            if len(self.cache) > 300:
                self.cache.clear()
            self.cache[host] = [self.make(s) for s in (self.table.value.get(host) if self.table is not None else row) or ()]
        return self.cache[host]


def _exemplar(s) -> tuple:
    tree = parse(s["sample"])
    order = number(tree)
    return s["ex"], s["sample"], tree, [own_text(x) for x in order]


def _wrapper(s) -> Wrapper:
    return Wrapper(parse(s["sample"]), s["path"], s["stays"], s["gone"], s["same"])


def _attach(pages: DataFrame, samples: DataFrame, most_bytes: int):
    """pages with a column ``samples``, and the broadcast table or None. Whether it may be broadcast
    is decided by its measured size. A host's pages are salted where they are shuffled, as one host
    may hold a third of all."""
    size = samples.agg(F.sum(F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.length(x["sample"]) + 8 * F.size(x["same"]) + 200))).first()[0] or 0
    if size <= most_bytes:
        table = {r["host"]: [x.asDict() for x in r["samples"]] for r in samples.toLocalIterator()}
        return pages.withColumn("samples", F.lit(None).cast(SAMPLES)), pages.sparkSession.sparkContext.broadcast(table)
    wide = samples.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return pages.withColumn("salt", F.pmod(F.xxhash64(*_ID), F.lit(_SALTS))).join(wide, ["host", "salt"], "left").drop("salt"), None


def _counted(counts) -> pa.RecordBatch:
    keys = list(counts)
    cols = [[k[i] for k in keys] for i in range(3)] + [[counts[k][i] for k in keys] for i in range(len(VOTES))]
    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(VOTES))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "ex", "node", *VOTES])


def wrappers(work: Workspace, pages: DataFrame, share: float = 0.9, many: int = 8, most_bytes: int = 32 << 20) -> DataFrame:
    """(host, samples): per host its exemplars and their wrappers, from the votes of all its pages."""
    usable = pages.where("host <> '' and length(html) > 0")
    # Per host the pages with the least and the greatest hash of their place, merged on the map side.
    # Among them those over a million characters come last, as they are exemplars like any other.
    key = F.struct((F.length("html") > 1_000_000).alias("long"), F.xxhash64(*_ID).alias("o"), *_ID)
    back = F.struct((F.length("html") > 1_000_000).alias("long"), (-F.xxhash64(*_ID)).alias("o"), *_ID)
    ends = usable.groupBy("host").agg(F.min(key).alias("x1"), F.min(back).alias("x2"))
    picked = ends.select("host", F.posexplode(F.array("x1", "x2")).alias("ex", "x")).select("host", "ex", F.col("x")["page_id"].alias("page_id"), F.col("x")["url"].alias("url"))
    picked = work.keep(picked, "picked")
    small = F.broadcast(picked) if picked.count() <= 200_000 else picked  # under 40 MB
    met = [usable["host"] == small["host"], usable["page_id"].eqNullSafe(small["page_id"]), usable["url"].eqNullSafe(small["url"])]
    chosen = usable.join(small, met).groupBy(small["host"].alias("host"), "ex").agg(F.min("html").alias("sample"))
    none = F.array().cast("array<int>")
    chosen = work.keep(chosen.select("host", F.struct("ex", "sample", none.alias("path"), none.alias("stays"), none.alias("gone"), none.alias("same")).alias("s")), "exemplars")
    samples = chosen.groupBy("host").agg(F.sort_array(F.collect_list("s")).alias("samples"))  # at most two
    voters, table = _attach(usable, samples, most_bytes)

    def votes(stream):
        own = _Table(table, _exemplar)
        counts: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0] * len(VOTES))
        for batch in stream:
            for host, page, row in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("samples").to_pylist(), strict=True):
                found = [x for x in own.of(host, row) if x[1] != page]
                if not found:
                    continue
                root = parse(page)
                nodes = number(root)
                for ex, _, tree, texts in found:
                    for node, *add in vote(tree, texts, root, nodes):
                        c = counts[(host, ex, node)]
                        for i, v in enumerate(add):
                            c[i] += v
            if len(counts) > 200_000:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    tally = voters.select("host", "html", "samples").mapInArrow(votes, "host string, ex int, node int, " + ", ".join(f"{v} long" for v in VOTES))
    tally = tally.groupBy("host", "ex", "node").agg(*[F.sum(v).alias(v) for v in VOTES])
    # At most the nodes of one page.
    sums = tally.groupBy("host", "ex").agg(F.collect_list(F.struct("node", *VOTES)).alias("votes"))
    known = chosen.select("host", F.col("s")["ex"].alias("ex"), F.col("s")["sample"].alias("sample")).join(sums, ["host", "ex"])

    def learn(stream):
        for batch in stream:
            out = []
            for r in batch.to_pylist():
                path, stays, gone, same = induce(parse(r["sample"]), {v["node"]: tuple(v[x] for x in VOTES) for v in r["votes"]}, share, many)
                out.append({"host": r["host"], "ex": r["ex"], "sample": r["sample"], "path": path, "stays": stays, "gone": gone, "same": same})
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("ex", pa.int32()), ("sample", pa.string()), ("path", ints), ("stays", ints), ("gone", ints), ("same", ints)]))

    made = known.mapInArrow(learn, "host string, " + _WRAPPER.replace(":", " ").replace(",", ", ")).where(F.size("path") > 0)
    return work.keep(made.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("ex", "sample", "path", "stays", "gone", "same"))).alias("samples")), "wrappers")


def extract_pages(pages: DataFrame, share: float = 0.9, many: int = 8, most_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""
    work = Workspace(pages.sparkSession, "html")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of(F.col("url")))
    met, table = _attach(pages, wrappers(work, pages, share, many, most_bytes), most_bytes)

    def read(stream):
        own = _Table(table, _wrapper)
        for batch in stream:
            hosts, html, rows = (batch.column(c).to_pylist() for c in ("host", "html", "samples"))
            texts = [extract(p, own.of(h, r)) for h, p, r in zip(hosts, html, rows, strict=True)]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return met.select("page_id", "url", "host", "html", "samples").mapInArrow(read, "page_id long, url string, text string, n_chars long")
