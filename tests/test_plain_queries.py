"""Queries without SQL against plain versions, on the smallest tables."""

import re
import unicodedata

import pytest

from folioq.plans import catalogue

DIR = "/root/testdata/sf0.001"
TERMS = ["the", "tion", "with"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()}


def folded(text):
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"[\W_]+", plain) if w]


def test_marked_snippets(spark, texts):
    got = {r["doc_id"]: r["snippet"] for r in catalogue.QUERIES["marked_snippets"](spark, DIR).collect()}
    assert set(got) == set(texts)
    for d, r in texts.items():
        if not (r["text"] or "").isascii():
            continue  # what folds beyond ASCII is the tokens' own matter
        words = folded(r["text"])
        counts = [len(set(words[i : i + 24]) & set(TERMS)) for i in range(max(1, len(words) - 23))]
        start = counts.index(max(counts))
        assert got[d] == " ".join(f"«{w}»" if w in TERMS else w for w in words[start : start + 24])


def test_section_chunks(spark, texts):
    found = {}
    for r in catalogue.QUERIES["section_chunks"](spark, DIR).collect():
        found.setdefault(r["id"], []).append((r["chunk_idx"], r["heading_path"], r["chunk"]))
    for d, r in texts.items():
        if re.search(r"^ {0,3}(#|```|~~~)", r["text"] or "", re.M):
            continue  # headings and fences of the text itself make more sections
        words = (r["text"] or "").split()
        starts = range(0, max(1, len(words) - 60), 160)
        wanted = [(i, [r["source"]], " ".join(words[s : s + 220])) for i, s in enumerate(starts)] if words else [(0, [], r["source"])]
        assert sorted(found.get(d, [])) == wanted


def test_search_snippets(spark):
    hits = {r["id"]: r for r in catalogue.QUERIES["search_snippets"](spark, DIR).collect()}
    marked = [r["snippet"] for r in hits.values() if "«" in r["snippet"]]
    assert hits and marked and all(re.findall("«([^»]*)»", s) and set(re.findall("«([^»]*)»", s)) <= {"of", "the", "with"} for s in marked)
    assert all(len(re.findall("«", s)) <= 3 and len(s.replace("«", "").replace("»", "").split()) <= 24 for s in marked)


def test_hashed_vectors(spark, texts):
    lengths = {}
    for r in catalogue.QUERIES["hashed_vectors"](spark, DIR).collect():
        assert 0 <= r["at"] < 1024
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["x"] ** 2
    worded = {d for d, r in texts.items() if r["text"] and any(len(w.encode()) > 1 for w in folded(r["text"]))}
    assert set(lengths) <= worded and len(lengths) > 0.95 * len(worded)
    assert all(abs(n - 1) < 1e-9 for n in lengths.values())
