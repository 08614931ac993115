"""Main text of web pages by consensus of a host's pages.

A first pass scores the containers of every page (text length of the blocks below, less what stands in links, decaying
with depth), lets the best one climb to the article around it, and votes for its path: the tags from the root with
their classes, digits generalised. Spark adds the votes up by host and path and picks one path for each host. A second
pass extracts every page again from the containers on its host's path; a page without one uses its own best container.

Within the container everything is kept but menus, headers (outside articles), footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments, known by tag, role, class or id. Character references are decoded, white
space inside a block becomes one space, blocks are joined in page order by one newline. A line break is white space.

Edge cases: null, empty and textless html gives ''; unclosed tags, stray end tags, cut-off pages and markup inside
scripts are expected; a null or unreadable url belongs to the host ''; null page_ids are kept; repeated rows are
extracted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import checked_join, materialise

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Tags that begin and end a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("td th br img wbr input".split())
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table td th body html div article section main".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe button select textarea svg dialog menu object canvas title head search datalist".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that mark what is not the article.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promotion nav navbar navigation navi menu menus submenu topbar breadcrumb breadcrumbs crumbs pager pagination "
    "footer foot sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification banner alert warning popup modal overlay newsletter subscribe subscription signup login signin paywall "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion skip toolbar masthead search".split()
)
#: Words beside a mark that tell the state of a page, as in has-sidebar or nav-open.
STATE_WORDS = frozenset("has have no not with without is open opened closed on off enabled disabled active visible".split())
#: A class or id that ends in such a word names a whole page, not a part of it, as in search-result-page.
PAGE_WORDS = frozenset("page pages layout template theme view site".split())
#: Marks that inside an article may stand on its own text; there they drop only what is mostly links.
UNSURE_WORDS = frozenset("response responses respond related share warning rail foot discussion search social".split())
#: Classes and ids of containers that count as an article for unsure marks.
MAIN_NAMES = frozenset("main main-content maincontent content article article-body post post-body post-content entry entry-content story".split())
HEADER_WORDS = frozenset("header head pageheader siteheader".split())
DECAY, TOP = 0.9, 5


@dataclass
class Element:
    tag: str
    path: str
    parent: int
    depth: int
    dropped: bool
    in_article: bool
    in_main: bool = False  # in an article or a container named like one
    hard: bool = False  # dropped for good
    soft: int = 0  # marked by class, id, role or form: 1; by unsure words inside an article: 2
    plain: int = 0  # characters outside and inside links of its own, then with all below
    linked: int = 0


@dataclass
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int, bool]] = field(default_factory=list)  # element, text, characters in links, is a heading


def _words(s: str) -> set[str]:
    """The words of classes and ids, but for those that tell a page's state or kind, or what something is of (notice-of-award)."""
    tokens = ([w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t).lower()) if w] for t in s.split())
    return {w for t in tokens if t and t[-1] not in PAGE_WORDS and "of" not in t and not STATE_WORDS.intersection(t) for w in t}


def parse(html: str) -> Page:
    """The page without what is dropped; marked elements that hold the article itself are kept."""
    page = _parsed(html, frozenset())
    if any(e.soft for e in page.elements):
        spared = _spared(page)
        if spared:
            page = _parsed(html, spared)
        if not page.blocks:
            page = _parsed(html, frozenset(i for i, e in enumerate(page.elements) if e.soft))
    return page


def _spared(page: Page) -> frozenset[int]:
    """Marked elements with nine tenths of the page's text outside links, those around its only articles, and unsure ones."""
    hard, marked = [False], [False]
    for e in page.elements[1:]:
        hard.append(hard[e.parent] or e.hard)
        marked.append(marked[e.parent] or bool(e.soft))
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        if not hard[i]:
            page.elements[e.parent].plain += e.plain
            page.elements[e.parent].linked += e.linked
    articles = [i for i, e in enumerate(page.elements) if e.tag in ("article", "main") and not hard[i] and e.plain]
    around: set[int] = set()
    if articles and all(marked[i] for i in articles):
        for i in articles:
            while i > 0:
                i = page.elements[i].parent
                around.add(i)
    total = page.elements[0].plain
    return frozenset(i for i, e in enumerate(page.elements) if e.soft and not hard[i] and (i in around or 10 * e.plain >= 9 * total > 0 or (e.soft == 2 and e.plain > e.linked)))


def _parsed(html: str, spared: frozenset[int]) -> Page:
    page = Page([Element("#root", "", -1, 0, False, False)])
    stack, text, linked, links, size, pos = [0], [], [], 0, len(html), 0

    def flush() -> None:
        nonlocal text, linked
        whole = " ".join("".join(text).split()) if text else ""
        if whole and not page.elements[stack[-1]].dropped:
            inside = len(" ".join("".join(linked).split())) if linked else 0
            page.blocks.append((stack[-1], whole, inside, any(page.elements[e].tag in ("h1", "h2") for e in stack[-3:])))
        text, linked = [], []

    def add(s: str) -> None:
        if not s:
            return
        e = page.elements[stack[-1]]
        if links:
            e.linked += len(s.strip())
        else:
            e.plain += len(s.strip())
        if not e.dropped:
            s = unescape(s)
            text.append(s)
            if links:
                linked.append(s)

    def close(at: int) -> None:
        nonlocal links
        if any(page.elements[e].tag in BLOCK for e in stack[at:]):
            flush()
        for e in stack[at:]:
            links -= page.elements[e].tag == "a"
        del stack[at:]

    for m in iter(lambda: TAG.search(html, pos), None):
        add(html[pos : m.start()])
        pos = m.end()
        end, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if end:
            if tag in SPACED:
                add(" ")
            for at in range(len(stack) - 1, 0, -1):
                if page.elements[stack[at]].tag == tag:
                    close(at)
                    break
                if tag not in SCOPE and page.elements[stack[at]].tag in ("td", "th", "table", "article", "body"):
                    break
            continue
        if tag in CLOSES_P:
            for at in range(len(stack) - 1, 0, -1):
                t = page.elements[stack[at]].tag
                if t == "p":
                    close(at)
                    break
                if t in BLOCK or t in ("td", "th"):
                    break
        for at in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            t = page.elements[stack[at]].tag
            if t in CLOSES[tag]:
                close(at)
                break
            if t in SCOPE and not (tag == "tr" and t in ("td", "th")):
                break
        if tag in BLOCK:
            flush()
        if tag in SPACED:
            add(" ")
        if tag in VOID:
            continue
        up = page.elements[stack[-1]]
        attributes = m.group(3) or ""
        name, hard, soft, in_article = tag, tag in DROP_TAGS and tag != "form", int(tag == "form"), up.in_article or tag in ("article", "main")
        in_main = up.in_main or in_article
        if len(attributes) > 3:
            a = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{a.get('class', '')} {a.get('id', '')}"
            marks = _words(names)
            in_main = in_main or a.get("role") == "main" or not MAIN_NAMES.isdisjoint(names.lower().split())
            if tag not in ("html", "body", "article", "main"):
                hard = hard or "hidden" in a or a.get("aria-hidden") == "true"
                if a.get("role", "").lower() in DROP_ROLES or (not up.in_article and bool(marks & HEADER_WORDS)) or marks & DROP_WORDS:
                    unsure = up.in_main and not soft and a.get("role", "").lower() not in DROP_ROLES and not marks & (DROP_WORDS - UNSURE_WORDS)
                    soft = 2 if unsure else 1
            if a.get("class"):
                name += "." + ".".join(sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in a["class"].split()}))
        hard = hard or (tag == "header" and not up.in_article)
        dropped = up.dropped or hard or (bool(soft) and len(page.elements) not in spared)
        page.elements.append(Element(tag, f"{up.path}/{name}" if tag in BLOCK or tag in CONTAINERS else up.path, stack[-1], up.depth + 1, dropped, in_article, in_main, hard, 0 if hard else soft))
        if tag in RAW:
            stop = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, pos)
            pos = stop.end() if stop else size
            continue
        stack.append(len(page.elements) - 1)
        links += tag == "a"
    add(html[pos:])
    flush()
    return page


def container_of(page: Page, element: int) -> int:
    while element > 0 and page.elements[element].tag not in CONTAINERS:
        element = page.elements[element].parent
    return element


def scores(page: Page) -> dict[int, float]:
    out: dict[int, float] = defaultdict(float)
    for e, text, linked, _ in page.blocks:
        worth, e = float(len(text) - linked), container_of(page, e)
        while e > 0:
            out[e] += worth
            worth *= DECAY
            e = container_of(page, page.elements[e].parent)
    return out


def best_container(page: Page, points: dict[int, float]) -> int:
    """The container with the most points, or the article or the titled container around it."""
    if not points:
        return 0
    best = min(points, key=lambda e: (-points[e], e))
    chain, e = [], best
    while e > 0:
        chain.append(e)
        e = container_of(page, page.elements[e].parent)
    for e in reversed(chain):
        if page.elements[e].tag == "article":
            return e
    for e in chain[1:]:
        below, inside = _inside(page, best), _inside(page, e)
        more = [b for b in inside if b not in below]
        if any(page.blocks[b][3] for b in more) and sum(len(page.blocks[b][1]) for b in more) * 2 <= sum(len(page.blocks[b][1]) for b in below):
            best = e
    return best


def _inside(page: Page, container: int) -> list[int]:
    out = []
    for b, (e, *_) in enumerate(page.blocks):
        while e > container:
            e = page.elements[e].parent
        if e == container:
            out.append(b)
    return out


def extract(page: Page, path: str | None) -> str:
    chosen = {i for i, e in enumerate(page.elements) if path and e.path == path and e.tag in CONTAINERS and not e.dropped}
    if not chosen or not any(_inside(page, e) for e in chosen):
        chosen = {best_container(page, scores(page))}
    return "\n".join(page.blocks[b][1] for b in sorted({b for e in chosen for b in _inside(page, e)}))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], float] = defaultdict(float)
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = parse(html or "")
            points = scores(page)
            best = best_container(page, points)
            if best:
                total[host, page.elements[best].path] += 1.0
        rows = [(h, p, v) for (h, p), v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["host", "path", "votes"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(parse(h or ""), p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), batch.column("path")], ["page_id", "url", "text", "n_chars", "path"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that most pages of a host vote for; the first by name on ties."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, votes double")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used by the host."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = checked_join(pages.withColumn("host", host_of(F.col("url"))), materialise(host_paths(pages)), "host", "left")
    return found.select("page_id", "url", "html", "path").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long, path string")
