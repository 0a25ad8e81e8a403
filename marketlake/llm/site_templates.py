"""Main text of web pages by site template removal.

Every page is read into elements; each element's subtree (tag, class, id, role, text and what it holds, in order) is
hashed. Spark counts the pages of a host on which a subtree occurs, pages of equal main text as one (so copies of an
article do not make it a template); a subtree found on at least ``MIN_PAGES`` of them and on ``MIN_SHARE`` of all
distinct pages of its host belongs to the site's template and is deleted, as are elements whose tag, role, class or id says that they are
no content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments). What is left
of the article (else of ``main``, else of a content container, else of the body) is the text.

A paragraph, heading, list item or cell inside marked content is prose, which revised articles of a host share too: it
belongs to the template only on ``PROSE_PAGES`` and on ``PROSE_SHARE`` of the host's distinct pages. An article, and an
element that holds at least half of the page's remaining text, stay however many pages repeat them. Template subtrees
are deleted by falling number of pages, prose last, those of one number together, as long as the deletions sum to less
than half of that text.

Character references are decoded, white space is turned into single spaces, blocks are joined by one space in page
order. Pages of one host may be a third of the table: counts are partial aggregates, and what a page must delete is
joined by page.

Defined results: null or empty html and pages without text give an empty text; broken markup is read as far as it goes
(an element ends where an enclosing one does); rows without a host (null or unreadable url) share the empty host;
repeated rows count as one page; a page of any length is read whole, in one task; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.llm.common import map_columns, stored

MIN_PAGES = 5
MIN_SHARE = 0.001
PROSE_PAGES = 10
PROSE_SHARE = 0.5

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                     r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
              "span strike strong sub sup time tt u var wbr".split())
#: Elements that a new element of the same group ends, up to the container named last.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NO_CONTENT = set("script style noscript template head nav footer aside form button select textarea iframe svg canvas "
                  "object dialog menu xmp noembed noframes datalist audio video map".split())
_NO_CONTENT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                        "toolbar".split())
_NO_CONTENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|"
    r"consent|gdpr|notices?|newsletter|subscribe|signup|sidebar|side-bar|menus?|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|comment-list|disqus|replies|respond|share|sharing|social|related|recommended|popup|modal|overlay|footer|"
    r"site-header|masthead|topbar|skip-link|pagination|pager|widget|toolbar)(?:$|[\s_-])", re.I)
_CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:content|main|article|post|entry|story|article-body|post-body)(?:$|[\s_-])", re.I)
_PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption address".split())


@dataclass
class Element:
    tag: str
    names: str
    role: str
    start: int
    end: int = -1
    digest: int = 0
    parts: list = field(default_factory=list)


@dataclass
class Page:
    pieces: list  # text and separators, in page order
    elements: list[Element]


def read_page(markup: str) -> Page:
    """Elements with the range of pieces each covers and the hash of its subtree."""
    pieces: list[str] = []
    elements: list[Element] = []
    stack: list[Element] = []
    opened: Counter = Counter()

    def close() -> None:
        e = stack.pop()
        opened[e.tag] -= 1
        e.end = len(pieces)
        e.digest = xxhash.xxh3_64_intdigest("\x1f".join([e.tag, e.names, e.role, *e.parts]).encode("utf-8", "replace"))
        e.digest -= (e.digest >> 63) << 64
        e.parts = []
        if stack:
            stack[-1].parts.append(f"\x1e{e.digest}")
        if e.tag not in _INLINE:
            pieces.append(" ")

    def text(raw: str) -> None:
        if raw:
            raw = entities.unescape(raw)
            pieces.append(raw)
            if stack and (flat := " ".join(raw.split())):
                stack[-1].parts.append(flat)

    at, n = 0, len(markup)
    while at < n:
        m = _MARKUP.search(markup, at)
        if m is None:
            tail = markup[at:]
            cut = re.search(r"<[/a-zA-Z!?][^<]*\Z", tail)  # a tag cut off at the end of the page
            text(tail[:cut.start()] if cut else tail)
            break
        text(markup[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                pieces.append(" ")
            elif opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag not in _INLINE:
            pieces.append(" ")
        if tag in _VOID:
            continue
        if tag not in _INLINE and opened["p"]:  # a block ends an open paragraph
            depth = len(stack) - 1
            while stack[depth].tag in _INLINE:
                depth -= 1
            if stack[depth].tag == "p":
                while len(stack) > depth:
                    close()
        if tag in _CLOSES and any(opened[x] for x in _CLOSES[tag][0]):
            group, within = _CLOSES[tag]
            for depth, e in enumerate(reversed(stack)):
                if e.tag in within:
                    break
                if e.tag in group:
                    for _ in range(depth + 1):
                        close()
                    break
        found = {a.lower(): entities.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3] or "")}
        e = Element(tag, f"{found.get('class', '')} {found.get('id', '')}".strip(), found.get("role", "").lower(), len(pieces))
        elements.append(e)
        stack.append(e)
        opened[tag] += 1
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(markup, at)
            raw = markup[at:end.start()] if end else markup[at:]
            if tag in ("title", "textarea"):
                text(raw)
            else:
                stack[-1].parts.append(raw)
            close()
            at = end.end() if end else n
        elif (m[3] or "").rstrip().endswith("/") and tag in ("svg", "path", "use"):
            close()
    while stack:
        close()
    return Page(pieces, elements)


def says_no_content(e: Element) -> bool:
    if e.tag in ("html", "body", "main"):
        return False
    if e.tag in _NO_CONTENT or e.role in _NO_CONTENT_ROLES:
        return True
    return bool(e.names and _NO_CONTENT_NAMES.search(e.names) and not (
        e.tag == "article" and not re.search("comment|repl", e.names, re.I)))


def _covered(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    step = [0] * (n + 1)
    for s, e in ranges:
        step[s] += 1
        step[e] -= 1
    out, level = [], 0
    for x in step[:n]:
        level += x
        out.append(level > 0)
    return out


def _content(page: Page, gone: list[bool]) -> list[tuple[int, int]] | None:
    """Ranges that hold the page's content, or None for a page without a marked one."""
    def of(keep) -> list[tuple[int, int]]:
        return [(e.start, e.end) for e in page.elements if keep(e) and e.end > e.start and not gone[e.start]]
    def has_text(ranges) -> bool:
        return any(page.pieces[i].strip() and not gone[i] for s, e in ranges for i in range(s, e))
    for keep in (lambda e: e.tag == "article", lambda e: e.tag == "main" or e.role == "main",
                 lambda e: bool(e.names and e.tag in ("div", "section", "td") and _CONTENT_NAMES.search(e.names))):
        if (ranges := of(keep)) and has_text(ranges):
            return ranges
    return None


def _marked(page: Page) -> list[bool]:
    dropped = [e for e in page.elements if says_no_content(e)]
    # the header of a site, not of an article
    articles = [(e.start, e.end) for e in page.elements if e.tag in ("article", "main")]
    dropped += [e for e in page.elements if e.tag == "header" and not any(s <= e.start and e.end <= t for s, t in articles)]
    return _covered([(e.start, e.end) for e in dropped], len(page.pieces))


def template_candidates(page: Page) -> list[tuple[int, bool]]:
    """(hash, whether it is prose) of the subtrees that the template may delete, each once."""
    gone = _marked(page)
    content = _content(page, gone)
    inside = _covered(content or [], len(page.pieces))
    words = [0]
    for piece in page.pieces:
        words.append(words[-1] + bool(piece.strip()))
    out = set()
    for e in page.elements:
        if e.end == e.start or gone[e.start] or e.tag in ("html", "body", "article", "main") or e.tag in _INLINE:
            continue
        if words[e.end] == words[e.start]:
            continue
        if content is not None and not inside[e.start]:
            continue  # outside the content: not part of the text in any case
        out.add((e.digest, content is not None and e.tag in _PROSE))
    return sorted(out)


def main_text(page: Page, template: dict[int, int]) -> str:
    """Text of the page without what is marked as no content and without the subtrees in ``template`` (hash: pages)."""
    gone = _marked(page)
    content = _content(page, gone)
    n = len(page.pieces)
    wanted = _covered(content, n) if content else [True] * n
    live = [w and not g for w, g in zip(wanted, gone)]
    if template:
        size = [0]
        for piece, ok in zip(page.pieces, live):
            size.append(size[-1] + (len(piece.strip()) if ok else 0))
        tiers = defaultdict(list)
        for e in page.elements:
            if (e.digest in template and e.tag not in ("html", "body", "article", "main") and e.tag not in _INLINE and 2 * (size[e.end] - size[e.start]) < size[-1]):
                tiers[not (content and e.tag in _PROSE), template[e.digest]].append((e.start, e.end))
        ranges: list[tuple[int, int]] = []
        for _, tier in sorted(tiers.items(), reverse=True):
            cut = _covered(ranges + tier, n)
            if 2 * sum(size[i + 1] - size[i] for i in range(n) if cut[i]) >= size[-1] > 0:
                break
            ranges += tier
        live = [ok and not c for ok, c in zip(live, _covered(ranges, n))]
    return " ".join("".join(p if ok else " " for p, ok in zip(page.pieces, live)).split())


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            prose_pages: int = PROSE_PAGES, prose_share: float = PROSE_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    # pages and hosts travel as hashes; that of a page covers its id, address and text
    keyed = pages.select("page_id", "url", "html", F.xxhash64(host()).alias("host"),
                         F.xxhash64("page_id", "url", "html").alias("k"))

    def candidates():
        def run(hosts, keys, htmls):
            out = {c: [] for c in ("host", "k", "main", "h", "prose")}
            for host_, key, html in zip(hosts, keys, htmls):
                page = read_page(html or "")
                main = xxhash.xxh3_64_intdigest(main_text(page, {}).encode("utf-8", "replace"))
                main -= (main >> 63) << 64
                for h, prose in ((None, False), *template_candidates(page)):  # None: the page itself
                    for c, v in zip(out, (host_, key, main, h, prose)):
                        out[c].append(v)
            return out
        return run

    found = stored(map_columns(keyed, ["host", "k", "html"], "host long, k long, main long, h long, prose boolean", candidates),
                   "page-subtrees")
    distinct = found.where(F.col("h").isNull()).groupBy("host").agg(F.count_distinct("main").alias("n_host"))
    often = found.where(F.col("h").isNotNull()).groupBy("host", "h", "prose").agg(F.count_distinct("main").alias("n"))
    least, share = (F.when(F.col("prose"), a).otherwise(b) for a, b in ((prose_pages, min_pages), (prose_share, min_share)))
    often = stored(often.where(F.col("n") >= least).join(distinct, "host")
                   .where(F.col("n") >= share * F.col("n_host")).select("host", "h", "prose", "n"), "site-templates")
    delete = (found.join(often, ["host", "h", "prose"]).groupBy("k").agg(F.collect_set(F.struct("h", "n")).alias("template"))
              .withColumnRenamed("k", "t_k"))
    joined = keyed.join(delete.hint("merge"), F.col("k") == F.col("t_k"), "left")

    def texts():
        def run(ids, urls, htmls, templates):
            got = [main_text(read_page(h or ""), {x["h"]: x["n"] for x in t or ()}) for h, t in zip(htmls, templates)]
            return {"page_id": ids, "url": urls, "text": got, "n_chars": [len(t) for t in got]}
        return run

    return map_columns(joined, ["page_id", "url", "html", "template"],
                       "page_id long, url string, text string, n_chars long", texts)


def op8_site_templates(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
