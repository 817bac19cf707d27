"""Plain versions of the operators, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text, k=4):
    w = words(lower(text))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def roots(docs):
    """docs: (id, text). For each the number of its component."""
    fps = [fingerprint(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(docs))]


def components(docs):
    """docs: (id, text). Rows (id, hex, component)."""
    fps, root, least = [fingerprint(t) for _, t in docs], roots(docs), {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    return [(d, f"{fps[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(docs)]


def hits(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[i : i + window])].add("" if item is None else str(item))
    lengths = {len(g) for g in grams}
    out = []
    for d, text in docs:
        w = split(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, window=20):
    first, places = {}, defaultdict(list)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, hashlib.md5(f":{docs[i][1] or ''}".encode()).hexdigest()))
    split = [words(t) for _, t in docs]
    for i in order:
        same = (docs[i][0], docs[i][1])
        for at in range(len(split[i]) - window + 1):
            g = tuple(split[i][at : at + window])
            first.setdefault(g, (same, at))
            places[i].append((g, at))
    out = []
    for i, (d, text) in enumerate(docs):
        gone = set()
        for g, at in places[i]:
            if first[g] != ((d, text), at):
                gone.update(range(at, at + window))
        kept = " ".join(w for at, w in enumerate(split[i]) if at not in gone)
        out.append((d, len(split[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def stats(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def language_model(docs, discount=0.8):
    """docs: (id, text). Rows (id, held, n, known, N, base, score)."""
    tokens = {i: [*words(lower(t)), "\n"] for i, (_, t) in enumerate(docs)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs]
    uni, bi = Counter(), Counter()
    for i, t in tokens.items():
        if not held[i]:
            uni.update(t)
            bi.update(zip(["\t", *t], t, strict=False))
    total, kinds = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += c
        kinds[a] += 1
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)

    def p2(a, w):
        if not total[a]:
            return p1(w)
        return max(bi[a, w] - discount, 0) / total[a] + discount * kinds[a] / total[a] * p1(w)

    out = []
    for i, (d, _) in enumerate(docs):
        t = tokens[i]
        out.append((d, held[i], len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(p2(a, w)) for a, w in zip(["\t", *t], t, strict=False))))
    return out


class Tree(HTMLParser):
    """A page as nested lists [tag, class, *children], a child being a list or a block's text. For pages of few kinds of elements."""

    holders = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul"}

    def __init__(self, page):
        super().__init__()
        self.root = ["", ""]
        self.stack, self.parts, self.skip = [self.root], [], ""
        self.feed(page or "")
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.stack[-1].append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.skip = tag
        elif tag in self.holders:
            self.flush()
            self.stack[-1].append([tag, dict(attrs).get("class") or ""])
            self.stack.append(self.stack[-1][-1])
        elif tag == "br":
            self.parts.append(" ")
        elif tag in ("p", "h1", "h2", "li"):
            self.flush()

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = ""
        elif tag in self.holders and tag in [x[0] for x in self.stack]:
            self.flush()
            while self.stack.pop()[0] != tag:
                pass
        elif tag in ("p", "h1", "h2", "li"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def below(tree):
    return [tree, *(y for x in tree[2:] if isinstance(x, list) for y in below(x))]


def main_texts(pages, min_pages=20, min_share=0.3):
    """pages: (id, url, html). Rows (id, text): article elements, or else the body, without clutter and without what recurs on the host's pages."""
    trees = [Tree(h).root for _, _, h in pages]
    hosts = [(re.findall("://([^/?#:]+)", u or "") or [""])[0] for _, u, _ in pages]
    on = Counter((h, x) for h, t in zip(hosts, trees, strict=True) for x in {repr(x) for x in below(t)})
    size = Counter(hosts)
    out = []
    for (page, _, _), host, tree in zip(pages, hosts, trees, strict=True):
        holds = lambda x: any(y[0] in ("article", "main") for y in below(x))
        has_main = holds(tree)

        def texts(x, inside, host=host, holds=holds, has_main=has_main):
            inside = inside or x[0] in ("article", "main")
            often = on[host, repr(x)]
            template = often >= min_pages and often >= min_share * size[host] and not holds(x) and x[0] not in ("", "html", "body") and len(x) > 2
            if template or x[0] in ("nav", "footer", "aside", "form", "header") or {"ad", "sidebar", "notice"} & set(x[1].split()):
                return []
            found = [texts(y, inside) if isinstance(y, list) else [y] * (inside or not has_main) for y in x[2:]]
            return [z for y in found for z in y]

        out.append((page, "\n\n".join(texts(tree, False))))
    return out
