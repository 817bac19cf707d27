"""Main text of web pages, with site templates found by counting element subtrees.

First pass: each page is parsed into elements and text blocks; every container element
outside running text gets a hash of its whole subtree. Spark counts, for each host, the
pages a subtree occurs on; tasks sum up first, so a host with a third of all pages is
as many rows as it has different subtrees. Subtrees on many pages of a host are its
template. Second pass: pages meet their host's templates and keep the blocks of the
main content that lie in neither a template nor an element whose tag, role or class
says that it is not the article.

A class, id or role counts only if it says nothing else: of "ad-slot" every part does, of
"notice-period" one does not. Inside article and main only words of adverts and reader
comments count, so a section on cookies or a list of related works stays. An aside there
that is a quote, a note or an example is text, and so is a fieldset. A header that holds the page's h1 is text where no article
or main element is. Such elements stand for the page only if they hold MAIN_SHARE of its
text outside clutter at least: a teaser in an article element displaces no text.

A host has few templates: each is on at least min_share of its pages. They are
broadcast while all together are under broadcast_rows, and else joined over salted
hosts.

Defined results: null and blank html give an empty text; a null or odd url is the host
""; broken markup is closed at the end of the page; a page without such an article or main
element uses its whole body; repeated rows count as pages of their own and give equal
rows; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

MIN_PAGES = 20
MIN_SHARE = 0.3
BROADCAST_ROWS = 50_000
SALTS = 32
PAGES_HELD = 64

#: Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas", "object", "audio", "video", "select"}
CLUTTER = RAW | {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "embed", "input", "fieldset", "datalist", "progress", "meter"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "hgroup", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "details", "blockquote", "address", "center"} | CLUTTER - {"input", "embed", "button", "progress", "meter"}
#: Dropped without ending the block around them.
INLINE = {"button", "progress", "meter"}
BLOCKS = (CONTAINERS - RAW) | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "td", "th", "caption", "figcaption", "summary", "legend", "option"}
VOID = {"br", "hr", "img", "input", "meta", "link", "base", "col", "embed", "source", "track", "wbr", "area", "param"}
COMMENTS = {"comment", "comments", "reply", "replies", "disqus"}
#: Words of class, id or role that mark what is not the article.
MARKS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay",
    "sidebar", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "menu", "navbar", "nav", "navigation", "topbar", "masthead", "footer", "copyright", "login", "signup", "search", "skip", "toolbar",
    "contentinfo", "complementary", "dialog",
}
#: Those of them that count inside the article as well.
MARKS_INSIDE = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
#: Words that add nothing to a mark beside them.
PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "center", "col", "column", "container", "content", "feed", "form", "frame", "group", "header",
    "holder", "icon", "icons", "image", "inline", "inner", "item", "items", "left", "letter", "link", "links", "list", "main", "media", "module", "news", "outer", "page", "panel", "post",
    "posts", "reader", "right", "row", "section", "site", "slot", "small", "story", "stories", "text", "thread", "title", "top", "unit", "up", "user", "view", "wrap", "wrapper",
    "by", "it", "now", "on", "this", "to", "us", "with", "your",
}
#: Words of asides that are text of the article.
QUOTES = {"quote", "pullquote", "pull", "callout", "example", "definition", "note", "tip", "highlight"}
MAIN_SHARE = 0.25
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _tokens(attributes: str):
    """The words of each part of class, id and role."""
    for name, value in _ATTRIBUTE.findall(attributes or ""):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                yield {w.lower() for w in _PART.findall(token) if not w.isdigit()}


def _marked(tag: str, attributes: str, in_main: bool = False) -> bool:
    if not attributes or attributes.isspace():
        return False
    marks = COMMENTS if tag == "article" else MARKS_INSIDE if in_main else MARKS
    if any(w & marks and w <= marks | PLAIN for w in _tokens(attributes)):
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "role" and value == "banner" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Element:
    __slots__ = ("tag", "inside", "marked", "quote", "head", "size", "dropped", "main", "hash", "content")

    def __init__(self, tag: str, inside: tuple, marked: bool, quote: bool = False):
        self.tag, self.inside, self.marked, self.quote = tag, inside, marked, quote
        self.head = self.dropped = self.main = False
        self.size = self.hash = 0
        self.content: list[str] = [tag]


def _decide(blocks: list[tuple[str, Element]], every: list[Element]) -> None:
    """Which elements are clutter and which the main content; every is in order of opening.

    A marked element that holds a heading or article and half of the page's text is layout, not clutter.
    """
    for words, element in blocks:
        for e in (*element.inside, element):
            e.size += len(words)
    whole = sum(len(w) for w, _ in blocks)
    for with_main in (True, False):
        for e in every:
            up = e.inside[-1]
            in_main = any(x.main for x in e.inside)
            clutter = e.tag in CLUTTER and not (in_main and (e.tag == "aside" and e.quote or e.tag == "fieldset" and not any(x.tag == "form" for x in e.inside))) or e.tag == "header" and not in_main and (with_main or not e.head)
            e.dropped = up.dropped or clutter or e.marked and not (e.head and 2 * e.size >= whole)
            e.main = with_main and not e.dropped and e.tag in ("article", "main")
        left = [(len(w), any(x.main for x in (*e.inside, e))) for w, e in blocks if not e.dropped]
        inside = sum(n for n, m in left if m)
        if inside and inside >= MAIN_SHARE * sum(n for n, _ in left):
            return


def parse(page: str | None) -> tuple[list[tuple[str, Element]], list[Element]]:
    """The text blocks of a page in order, each with its innermost element, and all container elements."""
    page = page or ""
    root = Element("", (), False)
    stack, every, blocks, text = [root], [], [], []
    mute, depth, dropped_block = "", 0, False

    def flush():
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words and not dropped_block:
            blocks.append((words, stack[-1]))
            stack[-1].content.append(words)

    def in_main():
        return any(e.tag in ("article", "main") for e in stack)

    def close():
        element = stack.pop()
        element.hash = xxhash.xxh64_intdigest("\x00".join(element.content)) >> 1
        stack[-1].content.append(str(element.hash))

    at = 0
    while match := _TAG.search(page, at):
        if not mute:
            text.append(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag, closing = match[2].lower(), match[1] == "/"
        if mute and tag not in BLOCKS:
            depth += (not closing) - closing if tag == mute else 0
            mute = mute if depth else ""
            continue
        if tag == "h1" and not closing:
            for e in stack:
                e.head = True
        if tag in BLOCKS:
            flush()
            mute, dropped_block = "", tag not in CONTAINERS and not closing and _marked(tag, match[3], in_main())
        elif tag == "br":
            text.append(" ")
        elif not closing and tag not in VOID and tag not in RAW and (tag in INLINE or _marked(tag, match[3], in_main())):
            mute, depth = tag, 1
        if tag not in CONTAINERS:
            continue
        if closing:
            if any(e.tag == tag for e in stack[1:]):
                flush()
                while stack[-1].tag != tag:
                    close()
                close()
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            quote = tag == "aside" and any(w & QUOTES for w in _tokens(match[3]))
            element = Element(tag, (*stack[-1].inside, stack[-1]), tag not in ("html", "body", "main") and _marked(tag, match[3], in_main()), quote)
            stack.append(element)
            every.append(element)
            if tag in ("article", "main"):
                for e in element.inside:
                    e.head = True
    if not mute:
        text.append(page[at:])
    flush()
    while len(stack) > 1:
        close()
    _decide(blocks, every)
    return blocks, every


def subtrees(every: list[Element]) -> set[int]:
    """Hashes of elements that can be template: none that is, holds or is all of the main content."""
    around = {id(x) for e in every if e.main for x in (*e.inside, e)}
    return {e.hash for e in every if id(e) not in around and e.tag not in ("html", "body", "blockquote") and len(e.content) > 1}


def main_text(page: str | None, templates: set[int]) -> str:
    blocks, every = parse(page)
    has_main = any(e.main for e in every)
    around = {id(x) for e in every if e.main for x in (*e.inside, e)}
    kept = []
    for words, element in blocks:
        line = (*element.inside, element)
        if element.dropped or has_main and not any(e.main for e in line):
            continue
        if templates and any(e.hash in templates and id(e) not in around and e.tag not in ("html", "body") for e in line):
            continue
        kept.append(words)
    return "\n\n".join(kept)


def _few(batches):
    """batches in parts of a few pages: of a part's pages a task holds the text beside the column."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_HELD):
            yield batch.slice(at, PAGES_HELD)


def _seen(batches):
    counts: Counter = Counter()

    def emit():
        pairs = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.int64()), pa.array([counts[p] for p in pairs], pa.int64())], names=["host", "subtree", "pages"])
        counts.clear()
        return out

    for batch in _few(batches):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[host, -1] += 1
            counts.update((host, k) for k in subtrees(parse(page)[1]))
            if len(counts) > 50_000:
                yield emit()
    if counts:
        yield emit()


def _extracted(batches):
    for batch in _few(batches):
        texts = [main_text(page, set(keys or ())) for page, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """pages: (host, html). Rows (host, keys): hashes of the subtrees on many pages of the host."""
    seen = stored(pages.select("host", "html").mapInArrow(_seen, "host string, subtree long, pages long").groupBy("host", "subtree").agg(F.sum("pages").alias("pages")), "subtrees")
    sizes = seen.where("subtree = -1").select("host", F.col("pages").alias("of"))
    many = seen.where(f"subtree <> -1 and pages >= {min_pages}").join(sizes, "host").where(F.col("pages") >= min_share * F.col("of"))
    return many.groupBy("host").agg(F.collect_set("subtree").alias("keys"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (page_id, url, text), one for each row of pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host.alias("host"))
    found = stored(templates(rows, min_pages, min_share), "templates")
    if (found.agg(F.sum(F.size("keys"))).first()[0] or 0) + found.count() <= broadcast_rows:
        met = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = dict(rows.dtypes)["page_id"]
    return met.select("page_id", "url", "html", "keys").mapInArrow(_extracted, f"page_id {kind}, url string, text string")


def op4_main_text(spark, sf_dir):
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
