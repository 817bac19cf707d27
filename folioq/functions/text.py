"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Lower-case letters whose decomposition is another letter and marks, that letter for each, and after them the marks, which go."""
    found = {}
    for code in (*range(0xC0, 0x590), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and chr(code) == chr(code).lower() and all(unicodedata.combining(x) for x in parts[1:]):
            found[chr(code)] = parts[0]
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


ACCENTED, PLAIN = _folds()
PAGE_TYPES = ("entities", "concepts", "sources", "topics")
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; null has none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain_tokens(text: str) -> list[str]:
    """The same of a query's text."""
    folded = text.lower().translate({ord(a): (PLAIN[i] if i < len(PLAIN) else None) for i, a in enumerate(ACCENTED)})
    return [w for w in re.split(r"[\W_]+", folded) if w]


def occurrences(text: Column, needle: str) -> Column:
    """How often needle stands in text, without overlaps."""
    t = F.coalesce(text, F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def slug_key(name: Column) -> Column:
    """Lower case, German umlauts spelled out, other runs than letters and digits as one hyphen."""
    spelled = F.lower(name)
    for letter, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(spelled, r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def alias_key(alias: Column) -> Column:
    """slug_key of what follows a page type prefix."""
    return slug_key(F.regexp_replace(alias, rf"^({'|'.join(PAGE_TYPES)})/", ""))


def umlaut_fold(key: Column) -> Column:
    out = key
    for letters, letter in (("ae", "a"), ("oe", "o"), ("ue", "u")):
        out = F.replace(out, F.lit(letters), F.lit(letter))
    return out


def match_key(key: Column) -> Column:
    """Keys that are long or compound once folded match without regard to umlaut spelling."""
    folded = umlaut_fold(key)
    return F.when((F.length(folded) >= 8) | F.contains(folded, F.lit("-")), folded).otherwise(key)


def similar_keys(a: Column, b: Column) -> Column:
    """Close spellings: equal when folded, or few edits for the shorter length."""
    shorter = F.least(F.length(a), F.length(b))
    allowed = F.when(shorter < 8, F.lit(1)).otherwise(F.lit(2))
    return (shorter >= 3) & ((umlaut_fold(a) == umlaut_fold(b)) | (F.levenshtein(a, b) <= allowed))


def short_title(title: Column) -> Column:
    """A title without a parenthesis at its end; null if it has none."""
    cut = F.trim(F.regexp_extract(title, r"^(.*\S)\s*\([^()]*\)\s*$", 1))
    return F.nullif(cut, F.lit(""))


def is_iso(date: Column) -> Column:
    return F.coalesce(date.rlike(ISO_DATE), F.lit(False))


def page_ref(raw: Column) -> Column:
    """A page id out of [[id|label]], id.md or a bare id."""
    bare = F.regexp_replace(F.trim(raw), r"^\[\[|\]\]$", "")
    return F.regexp_replace(F.trim(F.substring_index(bare, "|", 1)), r"\.md$", "")


#: Runs of white space, of any script.
WHITE = r"[\s\x0B\x85\p{Z}]+"


def joined_space(text: Column) -> Column:
    """White space joined and none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "))


def plain_snippet(text: Column, most: int = 80) -> Column:
    """Without markers, white space joined, cut at a word's end with an ellipsis and no mark before it: most characters at most."""
    flat = joined_space(F.regexp_replace(F.coalesce(text, F.lit("")), "[«»]", ""))
    head = F.substring(flat, 1, most - 1)
    cut = F.coalesce(F.nullif(F.regexp_extract(head, r"^(.+) [^ ]*$", 1), F.lit("")), head)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(cut, F.lit(" ,;:.-…")), F.lit("…")))


def safe_cell(value: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def contextual_header(title: Column, kind: Column, headings: Column, summary: Column) -> Column:
    """'title (type) › heading › heading', 160 characters at most; with ' — summary' behind it, 280 as a whole. White space is joined, empty parts are left out."""
    cut = lambda c, n: F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))
    name, of = (F.nullif(joined_space(c), F.lit("")) for c in (title, kind))
    head = F.concat_ws(" ", name, F.concat(F.lit("("), of, F.lit(")")))
    parts = F.concat(F.array(head), F.transform(F.coalesce(headings, F.array().cast("array<string>")), joined_space))
    line = cut(F.array_join(F.filter(parts, lambda p: p != ""), " › "), 160)
    short = joined_space(summary)
    return F.when(short == "", line).otherwise(cut(F.concat_ws(" — ", F.nullif(line, F.lit("")), short), 280))


def word_windows(text: Column, size: int = 220, stride: int = 160) -> Column:
    """Overlapping windows of words, the last one ending with the text, as structs (chunk_idx, chunk)."""
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    n = F.greatest(F.lit(0), F.ceil((F.size(found) - size) / stride)).cast("int")
    starts = F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n))
    return F.transform(F.array(found), lambda w: F.transform(starts, lambda i: F.struct(i.alias("chunk_idx"), F.array_join(F.slice(w, i * stride + 1, size), " ").alias("chunk"))))[0]
