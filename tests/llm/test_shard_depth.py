"""Large documents whose keys agree in more bits than the SQL of the shards looks at."""

from folioq.llm import sharding


def test_documents_alike_in_24_bits(spark):
    """Of sf0.1's texts 40 times; here short texts of the same keys under a limit that they exceed."""
    import hashlib

    seen, pair = {}, None
    for i in range(200_000):
        top = hashlib.md5(f"{i}:ab".encode()).hexdigest()[:6]
        if top in seen:
            pair = seen[top], i
            break
        seen[top] = i
    got = sharding.shard(spark.createDataFrame([(d, "ab") for d in pair], "doc_id long, text string"), 3).collect()
    assert sorted(r["doc"]["doc_id"] for r in got) == sorted(pair) and all(24 < len(r["shard"]) <= 48 and r["shard_bytes"] == 2 for r in got)
