"""Renames, deletions and merges over a table of pages, as rewrites of text and references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPE = "(entities|concepts|sources|topics)"
#: Forms of ids of pages that exist, and of those that are to be made.
ID_FORM = rf"^{_TYPE}(/[^/\\:\x00-\x1F\x7F-\x9F]+)+$"
NEW_ID_FORM = rf"^{_TYPE}(/[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9_-])?)+$"


def valid_id(page_id: Column) -> Column:
    """Relative paths under a page type, without empty or dotted segments, drive letters or control characters."""
    odd = F.contains(page_id, F.lit("..")) | page_id.rlike(r"(^|/)\.(/|$)")
    return F.coalesce(page_id.rlike(ID_FORM) & ~odd, F.lit(False))


def valid_new_id(page_id: Column) -> Column:
    """Of letters, digits, dots, underscores and hyphens only; no segment ends in a dot, the id not in .md."""
    return F.coalesce(page_id.rlike(NEW_ID_FORM) & valid_id(page_id) & ~F.endswith(page_id, F.lit(".md")), F.lit(False))


def retargeted(body: Column, old: str, new: str) -> Column:
    """Wiki and markdown links to exactly old point to new; labels and all else stay."""
    q = re.escape(old)
    safe = new.replace("\\", r"\\").replace("$", r"\$")
    wiki = F.regexp_replace(body, rf"\[\[{q}((?:#[^\[\]|]*)?(?:\|[^\[\]]*)?)\]\]", rf"[[{safe}$1]]")
    return F.regexp_replace(wiki, rf"(\[[^\[\]]*\])\({q}((?:\.md)?(?:#[^()\s]*)?)\)", rf"$1({safe}$2)")


def unlinked(body: Column, old: str) -> Column:
    """Links to exactly old become their label, or the id where they have none."""
    q = re.escape(old)
    labelled = F.regexp_replace(body, rf"\[\[{q}(?:#[^\[\]|]*)?\|([^\[\]]*)\]\]", "$1")
    bare = F.regexp_replace(labelled, rf"\[\[{q}(?:#[^\[\]|]*)?\]\]", old)
    return F.regexp_replace(bare, rf"\[([^\[\]]*)\]\({q}(?:\.md)?(?:#[^()\s]*)?\)", "$1")


def _moved(ids: Column, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(ids, lambda x: F.when(x == old, new).otherwise(x)))


def renamed(pages: DataFrame, old: str, new: str) -> DataFrame:
    """pages with old called new everywhere; nothing changes where new exists."""
    free = pages.where(F.col("id") == new).isEmpty()
    if not free:
        raise ValueError(f"{new} exists")
    follow = F.when(F.col("superseded_by") == old, new).otherwise(F.col("superseded_by"))
    return pages.withColumns({"id": F.when(F.col("id") == old, new).otherwise(F.col("id")), "body": retargeted(F.col("body"), old, new), "superseded_by": follow, "sources": _moved(F.col("sources"), old, new)})


def references(pages: DataFrame, page_id: str) -> DataFrame:
    """Other pages that link to page_id or name it in superseded_by or sources."""
    q = re.escape(page_id)
    linked = F.coalesce("body", F.lit("")).rlike(rf"\[\[{q}[\]|#]|\]\({q}(\.md)?[)#]")
    named = (F.coalesce("superseded_by", F.lit("")) == page_id) | F.coalesce(F.array_contains("sources", page_id), F.lit(False))
    return pages.where((F.col("id") != page_id) & (linked | named)).select("id")


def deleted(pages: DataFrame, page_id: str, force: bool = False) -> DataFrame:
    if not force and not references(pages, page_id).isEmpty():
        raise ValueError(f"{page_id} is referenced")
    rest = pages.where(F.col("id") != page_id)
    return rest.withColumns({"body": unlinked(F.col("body"), page_id), "superseded_by": F.when(F.col("superseded_by") != page_id, F.col("superseded_by")), "sources": F.array_remove("sources", page_id)})


def merged(pages: DataFrame, source: str, into: str) -> DataFrame:
    """source's body, tags, aliases and sources go to into; links follow; source goes."""
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("tags", "aliases", "sources")}
    given = pages.where(F.col("id") == source).select(F.col("body").alias("_body"), *[v.alias(f"_{c}") for c, v in lists.items()], F.coalesce("keep", F.lit(False)).alias("_keep"))
    met = pages.where(F.col("id") != source).join(F.broadcast(given), F.col("id") == into, "left")  # one row
    here = F.col("id") == into
    new = {c: F.when(here, F.array_remove(F.array_union(v, F.concat(F.coalesce(f"_{c}", none), F.array(F.lit(source)) if c == "aliases" else none)), into)).otherwise(F.col(c)) for c, v in lists.items()}
    new["body"] = F.when(here, F.concat_ws("\n\n", "body", "_body")).otherwise(F.col("body"))
    new["keep"] = F.when(here, F.coalesce("keep", F.lit(False)) | F.coalesce("_keep", F.lit(False))).otherwise(F.col("keep"))
    out = met.withColumns(new).select(*pages.columns)
    return out.withColumns({"body": retargeted(F.col("body"), source, into), "sources": _moved(F.col("sources"), source, into), "superseded_by": F.when(F.col("superseded_by") == source, into).otherwise(F.col("superseded_by"))})


def patched_section(body: Column, heading: str, text: str) -> Column:
    """The section from heading's line to the next heading of its level or above is replaced; appended if there is none."""
    level = len(heading) - len(heading.lstrip("#")) or 2
    line = heading if heading.startswith("#") else f"## {heading}"
    section = rf"(?sm)^{re.escape(line)}[ \t]*$.*?(?=^#{{1,{level}}} |\z)"
    new = f"{line}\n\n{text.strip()}\n\n"
    escaped = new.replace("\\", r"\\").replace("$", r"\$")
    b = F.coalesce(body, F.lit(""))
    return F.when(b.rlike(section), F.regexp_replace(b, section, escaped)).otherwise(F.concat(F.regexp_replace(b, r"\s+$", ""), F.lit("\n\n"), F.lit(new.rstrip() + "\n")))


def wiki_links(body: Column) -> Column:
    """Markdown links to pages become wiki links with their label, but not in code or table rows; doing it again changes nothing."""
    from folioq.functions.text import PAGE_TYPES

    target = rf"((?:{'|'.join(PAGE_TYPES)})/[^()\s?#]*?)(?:\.md)?(#[^()\s]*)?"
    link = rf"(?<!!)\[([^\[\]]*)\]\({target}\)"
    lines = F.split(F.coalesce(body, F.lit("")), "\n")

    def plain(line: Column) -> Column:
        pieces = F.split(line, "`")  # every second piece is code
        new = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, link, r"[[$2$3|$1]]")).otherwise(p))
        return F.array_join(new, "`")

    def add(state: Column, line: Column) -> Column:
        fence = line.rlike(r"^ {0,3}(```|~~~)")
        inside = state["code"] != fence
        kept = F.when(state["code"] | fence | F.ltrim(line).startswith("|"), line).otherwise(plain(line))
        return F.struct(F.array_append(state["out"], kept).alias("out"), inside.alias("code"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("code"))
    return F.aggregate(lines, start, add, lambda s: F.array_join(s["out"], "\n"))


def excerpt(body: Column, most: int = 140) -> Column:
    """The first line of prose, links as their text."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#|```|~~~|---|\|)"))
    first = F.regexp_replace(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"\[\[([^\[\]|]*\|)?([^\[\]]*)\]\]", "$2"), r"\[([^\[\]]*)\]\([^()]*\)", "$1")
    return F.substring(F.trim(first), 1, most)
