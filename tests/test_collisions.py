"""Collisions of names: every pair once, by any number of names, and the whole of large ones."""

import random
from itertools import combinations

import __spark_entry__
from test_pages import frame

from folioq.operators import names


def plain(pages):
    said = {frozenset((p["id"], o)) for p in pages for o in p["distinct_from"] or ()}
    alias = lambda p: {a.lower().replace(" ", "-") for a in p["aliases"]}
    own = lambda p: p["id"].split("/")[1]
    out = set()
    for p, q in combinations(sorted(pages, key=lambda p: p["id"]), 2):
        met = alias(p) & (alias(q) | {own(q)}) or alias(q) & {own(p)}
        if met and p["id"].split("/")[0] == q["id"].split("/")[0] and frozenset((p["id"], q["id"])) not in said:
            out.add((p["id"], q["id"]))
    return out


def test_pages_of_several_names(spark, monkeypatch):
    r = random.Random(5)
    ids = [f"{d}/n{i}" for d in ("entities", "topics") for i in range(30)]
    pages = [{"id": x, "aliases": [f"N{r.randrange(40)}" if r.random() < 0.5 else r.choice(["Same Thing", "Other Thing", "Third"]) for _ in range(r.randrange(5))], "distinct_from": r.choice([None, [], [r.choice(ids), None, r.choice(ids)]])} for x in ids]
    wanted = sorted(plain(pages))
    for piece in (1 << 13, 3):
        monkeypatch.setattr(names, "NAME_PIECE", piece)
        assert sorted(map(tuple, names.collisions(frame(spark, *pages), None).collect())) == wanted
    for cap in (2, 6):
        some = sorted(map(tuple, names.collisions(frame(spark, *pages), cap).collect()))
        assert len(set(some)) == len(some) and set(some) < set(wanted)
        assert {x for pair in some for x in pair} == {x for pair in wanted for x in pair}


def test_query_has_all_pairs_of_a_large_name(spark, tmp_path):
    """The SQL of alias_collisions has no cap: a name of more than NAME_CAP parts has all its pairs."""
    n = names.NAME_CAP + 100
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#11' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    assert __spark_entry__.queries()["alias_collisions"](spark, str(tmp_path)).count() == n * (n - 1) // 2


def test_pairs_are_not_shuffled(spark, tmp_path):
    spark.range(1, 9).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#11' AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    plan = __spark_entry__.queries()["alias_collisions"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Project") and plan[1].strip("+- ").startswith("Join Inner")
