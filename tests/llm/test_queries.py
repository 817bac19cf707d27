"""Every registered query over the smallest tables, against its SQL where it has one."""

import duckdb
import pytest

from folioq.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR).toPandas()
    source = {"op4_main_text": "count(*) from pages", "op11_conversation_repair": "count(distinct conv_id) from conversations"}
    assert name == "op13_ranked_search" or len(got) == con.execute(f"select {source.get(name, 'count(*) from documents')}").fetchone()[0]
    if name in ORACLES:
        wanted = con.execute(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(wanted.columns)
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, wanted[columns].astype(str).values))


def test_pipeline(spark, con):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "text", "shard"} <= set(out.columns)
    assert out.select("doc_id").distinct().count() <= con.execute("select count(*) from documents").fetchone()[0]
