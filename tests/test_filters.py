import pytest

from folioq.operators import filters as L

TODAY = "2026-10-06"
SCHEMA = "id string, type string, path string, title string, updated_at string, created string, valid_from string, valid_to string, superseded_by string, tags array<string>, summary string"


def page(id_, type_="entity", tags=(), **more):
    row = dict.fromkeys(("path", "title", "updated_at", "created", "valid_from", "valid_to", "superseded_by", "summary")) | {"id": id_, "type": type_, "tags": list(tags)} | more
    return tuple(row[c.split(" ")[0]] for c in SCHEMA.split(", "))


def run(spark, pages, query, access=()):
    frame = spark.createDataFrame(pages, SCHEMA)
    counts = spark.createDataFrame(list(access), "page_id string, reads long, search_hits long, last_read_at long")
    return L.run_query(frame, counts, query, TODAY)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_and_or(spark):
    pages = [page("entities/alice", tags=["nis2"]), page("entities/bob", tags=["dora"]), page("concepts/nlspec", "concept", ["nis2"])]
    assert ids(run(spark, pages, "type:entity AND (tag:nis2 OR tag:dora)")) == ["entities/alice", "entities/bob"]
    assert ids(run(spark, pages, "NOT tag:nis2")) == ["entities/bob"]
    assert len(ids(run(spark, pages, "NOT tag:>x"))) == 3
    assert ids(run(spark, pages, "*")) == ["concepts/nlspec", "entities/alice", "entities/bob"]


def test_updated(spark):
    pages = [page("entities/old", updated_at="2025-01-01"), page("entities/new", updated_at="2026-05-15"), page("entities/none")]
    assert ids(run(spark, pages, "updated:>2026-01-01")) == ["entities/new"]
    assert ids(run(spark, pages, "updated:<2026-01-01")) == ["entities/old", "entities/none"]


def test_validity(spark):
    pages = [page("a", valid_to="2025-12-31", superseded_by="b"), page("b"), page("c", valid_to="2025-01-31")]
    assert ids(run(spark, pages, "type:entity")) == ["b"]
    assert ids(run(spark, pages, "type:entity AND valid:all")) == ["a", "b", "c"]
    got = run(spark, pages, "valid:expired").collect()
    assert [(r["id"], r["validity"]) for r in got] == [("a", "superseded"), ("c", "expired")]
    edge = [page("on", valid_to=TODAY), page("later", valid_from="2027-01-01"), page("odd", valid_to="someday")]
    assert ids(run(spark, edge, "type:entity")) == ["odd", "on"]


def test_salience(spark):
    pages = [page("newer", updated_at="2026-05-01"), page("older", updated_at="2026-01-01")]
    got = run(spark, pages, "type:entity AND sort:salience", [("older", 3, 0, 5)]).collect()
    assert [(r["id"], r["reads"]) for r in got] == [("older", 3), ("newer", 0)]


def test_titles_fold_ascii_only(spark):
    pages = [page("a", title="Große ÄRA 100%"), page("b", title="große ära"), page("c")]
    assert ids(run(spark, pages, "title:GROß")) == ["a", "b"]
    assert ids(run(spark, pages, 'title:"ära"')) == ["b"]
    assert ids(run(spark, pages, "title:0%%")) == ["a"]
    assert ids(run(spark, pages, "NOT title:große")) == []


@pytest.mark.parametrize(
    ("query", "error"),
    [("foobar:x", L.UnknownField), ("type:entity OR sort:salience", L.MisplacedSort), ("type:", L.MissingValue), ('type:"x', L.UnclosedQuote), ("(type:x", L.MissingParen), ("type:x tag:y", L.UnexpectedToken), ("valid:soon", L.InvalidValue), ("valid:>now", L.InvalidValue), ("AND", L.UnexpectedToken), ("type", L.UnexpectedToken)],
)
def test_errors(query, error):
    with pytest.raises(error):
        L.compiled(query, TODAY)


def test_precedence():
    tree = L.parse("tag:foo AND tag:bar OR tag:baz")
    assert tree.kind == "or" and tree.parts[0].kind == "and"
    with pytest.raises(L.EmptyQuery):
        L.parse("  ")


def test_facet(spark):
    pages = [page("a", tags=["x", "y"]), page("b", tags=["y"])]
    assert [tuple(r) for r in L.tag_facet(spark.createDataFrame(pages, SCHEMA)).collect()] == [("y", 2), ("x", 1)]
