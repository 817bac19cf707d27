import random

import pytest
from pyspark.sql import functions as F

from folioq.functions.text import match_key, similar_keys, slug_key
from folioq.operators import graph, lint, names, refactor, upkeep

COLUMNS = "id string, type string, title string, body string, summary string, tags array<string>, aliases array<string>, sources array<string>, distinct_from array<string>, superseded_by string, valid_from string, valid_to string, updated_at string, keep boolean, file_mtime long"
NOW = 1_791_244_800
OLD = NOW - 91 * 86400


def frame(spark, *pages):
    names_ = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    base = dict.fromkeys(names_) | {"type": "entity", "title": "T", "summary": "s", "sources": ["entities/a"], "tags": [], "aliases": [], "file_mtime": OLD}
    return spark.createDataFrame([tuple((base | p)[n] for n in names_) for p in pages], COLUMNS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_links(spark):
    body = "[[entities/b]] [[entities/b|B]] [[entities/c#part]] [x](topics/d.md?x#y) [y](https://e.org/a) [z](../entities/q) [[#here]]"
    edges = graph.raw_edges(frame(spark, {"id": "entities/a", "body": body}))
    assert [r["raw"] for r in edges.collect()] == ["entities/b", "entities/b", "entities/c#part", "#here", "topics/d"]
    got = graph.index_edges(frame(spark, {"id": "entities/a", "body": body}, {"id": "entities/b"}))
    assert rows(got) == [("entities/a", "entities/b", False), ("entities/a", "entities/c", True), ("entities/a", "topics/d", True)]


def test_inbound_and_orphans(spark):
    pages = frame(spark, {"id": "a", "body": "[[b#x]] [[b]] [[a]]"}, {"id": "b", "body": ""}, {"id": "k", "keep": True}, {"id": "new", "file_mtime": NOW}, {"id": "zero", "file_mtime": 0})
    edges = graph.raw_edges(pages)
    assert rows(graph.inbound(edges)) == [("b#x", 1), ("b", 1)]
    assert [r["id"] for r in lint.orphans(pages, edges, NOW).collect()] == ["a"]


def test_components_and_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (200, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {i: 0 for i in range(51)} | dict.fromkeys((100, 101, 102), 100) | {200: 200}
    chains = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 5), (6, 7), (7, None)]
    assert rows(graph.returning_chains(spark.createDataFrame(chains, "id long, next long"))) == [(1, 3), (2, 3), (3, 3), (5, 1)]


def test_hub_threshold(spark):
    degree = spark.createDataFrame([(i, i) for i in range(1, 21)], "id long, degree long")
    assert graph.hub_threshold(degree).first()[0] == 17
    assert graph.hub_threshold(degree.where("id = 1")).first()[0] == 1


def test_lint(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pages = frame(
        spark,
        {"id": "entities/a", "title": None, "body": "[[entities/none]] [[#x]]\n| [[entities/b|B]] |", "superseded_by": "entities/b", "sources": []},
        {"id": "entities/b", "superseded_by": "entities/a", "summary": None, "body": "[a](entities/a.md)"},
        {"id": "entities/b", "superseded_by": "entities/a", "type": "odd", "body": ""},
        {"id": "topics/t", "type": "topic", "valid_from": "2026-02-01", "valid_to": "2026-01-01", "superseded_by": "gone", "body": "[[entities/b]]", "sources": ["raw/x"]},
        {"id": "topics/u", "type": "topic", "valid_to": "soon", "body": "[[topics/t]]"},
    )
    found = {(r["kind"], r["id"]) for r in lint.report(pages, "2026-10-06", NOW).collect()}
    assert {("missing-title", "entities/a"), ("broken-link", "entities/a"), ("missing-sources", "entities/a"), ("wikilink-pipe-in-table-cell", "entities/a"), ("duplicate-id", "entities/b"), ("missing-summary", "entities/b"), ("non-canonical-wiki-link", "entities/b"), ("unregistered-type", "entities/b"), ("supersede-cycle", "entities/a"), ("supersede-cycle", "entities/b"), ("dangling-supersede", "topics/t"), ("broken-source", "topics/t"), ("invalid-date", "topics/t"), ("invalid-date", "topics/u"), ("expired-but-linked", "topics/t"), ("orphan", "topics/u"), ("duplicate-candidate", "topics/t"), ("duplicate-candidate", "topics/u")} == found


def test_names(spark):
    pages = frame(spark, {"id": "entities/mueller-gmbh"}, {"id": "entities/michal"}, {"id": "topics/muller-gmbh"}, {"id": "entities/acme", "aliases": ["Müller GmbH"]})
    assert rows(names.find_matches(pages, "entities/muller-gmbh")) == [("entities/acme", "alias"), ("entities/mueller-gmbh", "normalised")]
    assert rows(names.find_matches(pages, "entities/michael")) == [("entities/michal", "similar")]
    assert names.blocks_creation(names.find_matches(pages, "entities/michael")).count() == 0
    assert rows(names.collisions(pages)) == [("entities/acme", "entities/mueller-gmbh")]
    alias = frame(spark, {"id": "entities/m", "aliases": ["Mustermann GmbH"]}, {"id": "entities/mae-ae-oe"})
    assert rows(names.find_matches(alias, "entities/mustermann-gmbx")) == [("entities/m", "similar")]
    asked = spark.createDataFrame([(x,) for x in ("entities/mustermann-gmbx", "entities/muller-gmbh", "entities/michael", "topics/mueler-gmbh", "entities/-")], "id string")
    found = {tuple(r) for r in names.near_matches(pages.unionByName(alias), asked).collect()}
    assert found == {(a["id"], *r) for a in asked.collect() for r in rows(names.find_matches(pages.unionByName(alias), a["id"]))} and len(found) == 5
    apart = frame(spark, {"id": "entities/mueller-gmbh"}, {"id": "entities/acme", "aliases": ["Müller GmbH"], "distinct_from": ["entities/mueller-gmbh"]})
    assert names.collisions(apart).count() == 0


def test_large_names_lose_no_page(spark):
    """Pages that are distinct from the first one of a name still meet another."""
    few = [{"id": f"entities/p{i}", "aliases": ["One Name"], "distinct_from": ["entities/p0", "entities/p1"] if i == 5 else None} for i in range(8)]
    keyed = [{"id": f"entities/{x}", "distinct_from": ["entities/a_b"] if x == "a.b" else None} for x in ("a_b", "a.b", "a b", "a-b", "A-B", "a+b")]
    pages = frame(spark, *few, *keyed)
    full = {tuple(r) for r in names.collisions(pages).collect()}
    star = {tuple(r) for r in names.collisions(pages, 4).collect()}
    assert len(full) == 26 + 14 and star < full
    assert {x for pair in full for x in pair} == {x for pair in star for x in pair} == {p["id"] for p in (*few, *keyed)}
    assert ("entities/p2", "entities/p5") in star and ("entities/p0", "entities/p5") not in star
    titled = frame(spark, *({"id": f"m{i}", "title": "many", "distinct_from": ["m0"] if i == 3 else None} for i in range(11)))
    pairs = {tuple(r) for r in names.title_pairs(titled)[0].collect()}
    assert ("m1", "m3") in pairs and ("m0", "m3") not in pairs and len(pairs) == 10


def test_title_and_content_pairs(spark):
    pages = frame(spark, {"id": "a", "title": "X (Mutter)"}, {"id": "b", "title": "x"}, {"id": "c", "title": "X (Tochter)"}, {"id": "d", "title": "Notes"}, {"id": "e", "title": "notes"}, *({"id": f"m{i}", "title": "many"} for i in range(11)))
    pairs, notes = names.title_pairs(pages)
    assert rows(notes) == [("entity", "many", 11)]
    # A title of too many pages for all pairs: each page with the first.
    many = pairs.where("a like 'm%'")
    assert sorted(r["b"] for r in many.collect()) == sorted(f"m{i}" for i in range(1, 11)) and {r["a"] for r in many.collect()} == {"m0"}
    pairs = pairs.where("a not like 'm%'")
    assert rows(pairs) == [("a", "b"), ("b", "c")]
    v = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [0.8, 0.6]), ("c", "t", [0.99, 0.141]), ("d", "u", [1.0, 0.0])], "id string, type string, embedding array<double>")
    near, note = names.content_pairs(v)
    assert rows(near) == [("a", "c", 0.99)] and note.count() == 0
    capped, note = names.content_pairs(v, cap=2, asked=F.col("id") == "c")
    assert rows(note) == [("t", 3)] and rows(capped) == [("a", "c", 0.99)]
    got = names.ranked_pairs(pairs, near, v).collect()
    assert [tuple(r) for r in got] == [("a", "c", 0.99, False, "merge"), ("b", "c", 0.8766, True, "merge"), ("a", "b", 0.8, True, "merge")]


def test_queue(spark):
    log = [("orphan", "x", "skipped"), ("orphan", "x", "skipped"), ("orphan", "x", "done"), ("orphan", "x", "skipped"), ("decay", "y", "deferred"), ("decay", "y", "deferred"), ("merge", "a", "done")]
    log = spark.createDataFrame([(*x, i) for i, x in enumerate(log)], "kind string, pages string, outcome string, seq long")
    assert rows(upkeep.skip_counts(log)) == [("decay", "y", 2), ("orphan", "x", 1)]
    assert [tuple(r) for r in upkeep.log_stats(log).collect()] == [("orphan", 1, 3, 0, 4), ("decay", 0, 0, 2, 2), ("merge", 1, 0, 0, 1)]
    work = [("decay-candidate", ["p"], 1), ("broken-link", ["p"], 2), ("orphan", ["q"], 3), ("orphan", ["r"], 4), ("no-kind", ["z"], 0)]
    work = spark.createDataFrame([(k, p, None, "why", s) for k, p, s in work], QUEUED)
    skips = spark.createDataFrame([("orphan", "q", 3)], "kind string, pages string, skipped long")
    got = [(r["kind"], r["pages"], r["omitted"]) for r in upkeep.work_queue(work, skips, cap=2).orderBy("place").collect()]
    assert got == [("broken-link", ["p"], 1), ("orphan", ["r"], 1)]
    assert upkeep.work_queue(work, skips).where("pages[0] = 'q'").first()["reason"] == "why (skipped 3× before — decide or mark keep)"
    assert upkeep.work_queue(work.limit(0), skips).count() == 0


QUEUED = "kind string, pages array<string>, action string, reason string, seq long"


def test_queue_against_one_after_another(spark):
    """Items taken in order of rank, each only if no taken item of another kind of work covers one of its pages."""
    r = random.Random(6)
    page = lambda: f"p{r.randint(0, 40):02d}"
    work = []
    for seq in range(150):
        kind = r.choice([*list(upkeep.KINDS), "duplicate-candidate", "duplicate-candidate"])
        ids = sorted({page(), page(), page()})[:2] if kind == "duplicate-candidate" else [page()]
        if len(ids) == 1 and kind == "duplicate-candidate":
            continue
        work.append((kind, ids, r.choice([None, upkeep.PAIR_CHECK]) if len(ids) == 2 else None, "", seq))
    covered, taken = {}, []
    names_ = list(upkeep.KINDS)
    for kind, ids, action, _, seq in sorted(work, key=lambda w: (upkeep.KINDS[w[0]][0], names_.index(w[0]), w[4])):
        action = action or upkeep.KINDS[kind][1]
        pair = lambda a: a in ("merge", upkeep.PAIR_CHECK)
        free = lambda a, b: pair(a) and b == "fix-link" or a == "fix-link" and pair(b)
        if all(free(a, action) for p in ids for a in covered.get(p, [])):
            taken.append((kind, ids, seq))
            for p in ids:
                covered.setdefault(p, []).append(action)
    skips = spark.createDataFrame([], "kind string, pages string, skipped long")
    got = upkeep.work_queue(spark.createDataFrame(work, QUEUED), skips, cap=1000).orderBy("place").collect()
    assert [(x["kind"], x["pages"]) for x in got] == [(k, p) for k, p, _ in taken]


def test_chosen_pairs_in_few_rounds(spark, monkeypatch):
    """A chain whose pairs depend on each other one by one, and many small components."""
    written = []
    real = upkeep.stored
    monkeypatch.setattr(upkeep, "stored", lambda df, name: written.append(name) or real(df, name))
    chain = spark.range(10_000).select(F.format_string("p%05d", "id").alias("a"), F.format_string("p%05d", F.col("id") + 1).alias("b"), F.col("id").alias("seq"))
    assert [x["seq"] for x in upkeep._chosen_pairs(chain).orderBy("seq").collect()] == list(range(0, 10_000, 2))
    assert len(written) == 2
    rest = spark.range(300).select(F.format_string("q%03d", F.col("id") - F.col("id") % 3).alias("a"), F.format_string("q%03dx", F.col("id")).alias("b"), (-F.col("id")).alias("seq"))
    written.clear()
    got = upkeep._chosen_pairs(chain.where("id < 400").unionByName(rest), 100)
    assert sorted(x["seq"] for x in got.collect()) == sorted([*range(0, 400, 2), *(-i for i in range(2, 300, 3))])
    assert len(written) <= 15


def test_candidates_of_a_vault(spark):
    old = {"file_mtime": 1, "keep": False}
    pages = frame(
        spark,
        {"id": "entities/a", "title": "Same", "body": "[[entities/none]] [[entities/b]]", **old},
        {"id": "entities/b", "title": "same", "sources": ["sources/gone"], "body": "", **old},
        {"id": "topics/c", "title": "C", "body": "[[entities/a]]", "summary": "s", **old},
    )
    access = spark.createDataFrame([("entities/x", 1)], "page_id string, reads long")
    index = spark.createDataFrame([("topics/c", "old", "new")], "id string, summary_body_hash string, body_hash string")
    found = {(r["kind"], tuple(r["pages"]), r["reason"]) for r in upkeep.candidates(pages, access, NOW, index=index).collect()}
    assert {(k, p) for k, p, _ in found} == {("duplicate-candidate", ("entities/a", "entities/b")), ("broken-link", ("entities/a",)), ("broken-source", ("entities/b",)), ("summary-stale", ("topics/c",)), ("decay-candidate", ("topics/c",)), ("orphan", ("topics/c",))}
    assert ("broken-link", ("entities/a",), "links to missing page(s): entities/none") in found
    skips = spark.createDataFrame([], "kind string, pages string, skipped long")
    queue = upkeep.work_queue(upkeep.candidates(pages, access, NOW), skips).orderBy("place").collect()
    assert [(r["kind"], r["action"]) for r in queue] == [("duplicate-candidate", "check-or-distinct"), ("broken-link", "fix-link"), ("broken-source", "fix-link"), ("decay-candidate", "archive-or-supersede")]


def test_refactor(spark):
    pages = frame(spark, {"id": "entities/a", "body": "x [[entities/b|B]] [[entities/b]] [l](entities/b.md) [[entities/bb]]", "sources": ["entities/b"], "superseded_by": "entities/b"}, {"id": "entities/b", "body": "self", "tags": ["t"], "sources": []})
    new = {r["id"]: r for r in refactor.renamed(pages, "entities/b", "entities/new").collect()}
    assert new["entities/a"]["body"] == "x [[entities/new|B]] [[entities/new]] [l](entities/new.md) [[entities/bb]]"
    assert new["entities/a"]["sources"] == ["entities/new"] and new["entities/a"]["superseded_by"] == "entities/new"
    with pytest.raises(ValueError):
        refactor.renamed(pages, "entities/b", "entities/a")
    with pytest.raises(ValueError):
        refactor.deleted(pages, "entities/b")
    left = refactor.deleted(pages, "entities/b", force=True).collect()
    assert [(r["body"], r["superseded_by"], r["sources"]) for r in left] == [("x B entities/b l [[entities/bb]]", None, [])]
    one = refactor.merged(pages, "entities/b", "entities/a").collect()
    assert len(one) == 1 and one[0]["body"].endswith("\n\nself") and one[0]["tags"] == ["t"] and one[0]["aliases"] == ["entities/b"]
    body = spark.createDataFrame([("# T\n\n## A\nold\n### sub\n\n## B\nb\n",)], "b string")
    assert body.select(refactor.patched_section(F.col("b"), "## A", "new")).first()[0] == "# T\n\n## A\n\nnew\n\n## B\nb\n"
    assert body.select(refactor.patched_section(F.col("b"), "## C", "c")).first()[0].endswith("## B\nb\n\n## C\n\nc\n")


def test_history_and_changes(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, text string")
    index = pages.select("id", F.sha2("text", 256).alias("file_hash")).where("id = 'a'").union(spark.createDataFrame([("z", "h")], "id string, file_hash string"))
    assert {(r["id"], r["state"]) for r in upkeep.changed(pages, index).collect()} == {("a", "unchanged"), ("b", "new"), ("z", "gone")}
    deltas = spark.createDataFrame([("s1", "p", "A", 3, 0), ("s2", "q", "M", 1, 1), ("s3", "p", "D", 0, 3)], "sha string, path string, status string, added long, removed long")
    commits = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3)], "sha string, ts long")
    assert [r["sha"] for r in upkeep.page_history(deltas, commits, "p", 5).collect()] == ["s3", "s1"]
    assert upkeep.commit_changes(deltas).where("sha = 's3'").first()["n_d"] == 1


def test_near_names_of_all_lengths(spark):
    """Names around the lengths at which their meeting changes; and no side of a join goes to the driver, as each is far larger than its table."""
    long = "abcdefghijklmnopqrstuvwxyz0123456789"
    keys = [long[:n] for n in (3, 6, 7, 8, 9, 30, 31, 32, 33, 34, 36)]
    pages = frame(spark, *({"id": f"entities/{k}", "aliases": ["One Name"]} for k in keys))
    edits = [k[:2] + x + k[2 + cut :] for k in keys for x, cut in (("", 1), ("", 2), ("_", 1), ("77", 0), ("7", 2))] + [k[:1] + k[2:-1] for k in keys] + ["one-name", "one-nam"]
    asked = spark.createDataFrame([(f"entities/{k}",) for k in dict.fromkeys(edits)], "id string")
    found = names.near_matches(pages, asked)
    key = F.substring_index("wanted", "/", -1)
    every = names.name_entries(pages).crossJoin(asked.withColumnRenamed("id", "wanted")).where("id <> wanted")
    every = every.withColumn("reason", names._reason(F.col("is_alias"), F.col("match") == match_key(slug_key(key)), similar_keys(F.col("key"), slug_key(key))))
    wanted = {(r["wanted"], r["id"], names.REASONS[r["r"]]) for r in every.where("reason is not null").groupBy("wanted", "id").agg(F.min("reason").alias("r")).collect()}
    assert {tuple(r) for r in found.collect()} == wanted and len(wanted) > 50
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
