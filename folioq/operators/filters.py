"""The page filter language, turned into Column expressions.

    type:entity AND (tag:nis2 OR tag:dora) AND NOT title:draft AND sort:salience

OR binds weakest, then AND, then NOT. Fields: id, type, title, tag, created, updated, valid, sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions.text import is_iso

FIELDS = ("id", "type", "title", "tag", "created", "updated", "valid", "sort")
CHOICES = {"valid": ("now", "all", "expired"), "sort": ("updated", "salience")}


class FilterError(ValueError):
    """What is wrong with a query."""


class UnexpectedToken(FilterError): ...


class UnknownField(FilterError): ...


class InvalidValue(FilterError): ...


class MisplacedSort(FilterError): ...


class MissingValue(FilterError): ...


class UnclosedQuote(FilterError): ...


class EmptyQuery(FilterError): ...


class MissingParen(FilterError): ...


@dataclass(frozen=True)
class Clause:
    field: str
    sign: str
    value: str


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple


_TOKEN = re.compile(r'\s*(?:"(?P<quoted>[^"]*)"|(?P<sign>:[<>]?)|(?P<paren>[()])|(?P<word>[^\s():"]+)|(?P<open>"))')


def _tokens(query: str) -> list[tuple[str, str]]:
    out = []
    for m in _TOKEN.finditer(query.rstrip()):
        if m["open"]:
            raise UnclosedQuote(query)
        kind = m.lastgroup
        out.append(("keyword", m["word"].upper()) if kind == "word" and m["word"].upper() in ("AND", "OR", "NOT") else (kind, m[kind]))
    return out


def parse(query: str) -> Clause | Node:
    rest = _tokens(query)
    if not rest:
        raise EmptyQuery(query)

    def take(kind: str, text: str | None = None) -> str | None:
        if rest and rest[0][0] == kind and text in (None, rest[0][1]):
            return rest.pop(0)[1]
        return None

    def joined(word: str, inner) -> Clause | Node:
        parts = [inner()]
        while take("keyword", word):
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Node(word.lower(), tuple(parts))

    def either():
        return joined("OR", lambda: joined("AND", negated))

    def negated():
        return Node("not", (negated(),)) if take("keyword", "NOT") else single()

    def single():
        if take("paren", "("):
            inner = either()
            if take("paren", ")") is None:
                raise MissingParen(query)
            return inner
        name = take("word")
        if name is None:
            raise UnexpectedToken(rest[0][1] if rest else "end of query")
        field = name.lower()
        if field not in FIELDS:
            raise UnknownField(name)
        sign = take("sign")
        if sign is None:
            raise UnexpectedToken(name)
        value = take("word")
        value = take("quoted") if value is None else value
        if value is None:
            raise MissingValue(name)
        if field in CHOICES:
            value = value.lower()
            if sign != ":" or value not in CHOICES[field]:
                raise InvalidValue(f"{field}{sign}{value}")
        return Clause(field, sign, value)

    tree = either()
    if rest:
        raise UnexpectedToken(rest[0][1])
    return tree


def _mentions(tree, field: str) -> bool:
    return tree.field == field if isinstance(tree, Clause) else any(_mentions(p, field) for p in tree.parts)


def _without_sort(tree) -> tuple[Clause | Node | None, str | None]:
    """sort: is allowed along the outer ANDs only; the last one counts."""
    if isinstance(tree, Clause) and tree.field == "sort":
        return None, tree.value
    if isinstance(tree, Node) and tree.kind == "and":
        kept, order = [], None
        for part in tree.parts:
            left, found = _without_sort(part)
            order = found or order
            if left is not None:
                kept.append(left)
        return (None if not kept else kept[0] if len(kept) == 1 else Node("and", tuple(kept))), order
    if _mentions(tree, "sort"):
        raise MisplacedSort()
    return tree, None


def valid_now(today: str) -> Column:
    """Dates that don't have the shape of a date count as absent."""
    until = ~is_iso(F.col("valid_to")) | (F.col("valid_to") >= today)
    since = ~is_iso(F.col("valid_from")) | (F.col("valid_from") <= today)
    return until & since & (F.coalesce("superseded_by", F.lit("")) == "")


def _compared(column: Column, sign: str, value: str) -> Column:
    return {":": column == value, ":>": column > value, ":<": column < value}[sign]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _clause(c: Clause, today: str) -> Column:
    blank = lambda name: F.coalesce(name, F.lit(""))
    if c.field == "valid":
        return {"now": valid_now(today), "all": F.lit(True), "expired": ~valid_now(today)}[c.value]
    if c.field == "tag":
        return F.array_contains("tags", c.value) if c.sign == ":" else F.lit(False)
    if c.field == "title" and c.sign == ":":
        pattern = F.replace(_ascii_lower(F.lit(f"%{c.value}%")), F.lit("\\"), F.lit("\\\\"))
        return F.like(_ascii_lower(F.col("title")), pattern)
    column = {"id": F.col("id"), "type": F.col("type"), "title": blank("title"), "created": blank("created"), "updated": blank("updated_at")}[c.field]
    return _compared(column, c.sign, c.value)


def condition(tree: Clause | Node, today: str) -> Column:
    if isinstance(tree, Clause):
        return _clause(tree, today)
    parts = [condition(p, today) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    return reduce(lambda a, b: a & b if tree.kind == "and" else a | b, parts)


def compiled(query: str, today: str) -> tuple[Column, list[Column]]:
    """The condition and the order of a query. Without valid: only pages valid today are meant."""
    text = query.strip()
    tree, order = _without_sort(parse("valid:now" if text in ("", "*") else text))
    where = F.lit(True) if tree is None else condition(tree, today)
    if tree is None or not _mentions(tree, "valid"):
        where = where & valid_now(today)
    by = [F.desc(F.coalesce("updated_at", F.lit(""))), F.asc("id")]
    if order == "salience":
        by.insert(0, F.desc(F.col("reads") * 2 + F.col("search_hits")))
    return where, by


def validity(today: str) -> Column:
    """superseded, expired, upcoming or current, the first that holds."""
    return (
        F.when(F.coalesce("superseded_by", F.lit("")) != "", "superseded")
        .when(is_iso(F.col("valid_to")) & (F.col("valid_to") < today), "expired")
        .when(is_iso(F.col("valid_from")) & (F.col("valid_from") > today), "upcoming")
        .otherwise("current")
    )


def run_query(pages: DataFrame, access: DataFrame, query: str, today: str, prefix: str = "") -> DataFrame:
    """pages with counts, in the query's order."""
    where, by = compiled(query, today)
    counts = access.select(F.col("page_id").alias("id"), "reads", "search_hits", "last_read_at")
    rows = pages.join(counts, "id", "left").fillna(0, ["reads", "search_hits"])
    hits = rows.where(where & F.startswith("id", F.lit(prefix)))
    return hits.withColumn("tags", F.sort_array("tags")).withColumn("validity", validity(today)).withColumn("summary", F.nullif(F.trim("summary"), F.lit(""))).orderBy(*by)


PAGE, MOST, SHOWN = 100, 500, 200


def paged(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    return rows.offset(max(0, offset)).limit(min(MOST, max(1, PAGE if limit is None else limit)))


def page_with_total(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of rows, each with total and next_offset (null on the last page)."""
    page, size = paged(rows, offset, limit), min(MOST, max(1, PAGE if limit is None else limit))
    total = rows.agg(F.count("*").alias("total"))  # one row
    after = max(0, offset) + size
    return page.join(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > after, F.lit(after)))


def first_with_total(rows: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first rows of a list with its true total."""
    return rows.limit(most).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def tag_facet(pages: DataFrame) -> DataFrame:
    """Rows (tag, pages), the most frequent first."""
    return pages.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "tag")
