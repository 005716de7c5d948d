import zlib
from collections import defaultdict

import pytest
from memlake.llm import sharding

SCHEMA = "doc_id long, text string, size string, _sz int, shard int"
ROWS = [(i, f"text {i % 37} " * (1 + i % 50), "x", 1, 5) for i in range(600)] + [(7, None, None, None, None), (None, "", "y", 2, 3)] * 3


def check(got, shards, law="bytes"):
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(shards)]
    counts = [len(by[k]) for k in range(shards)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.op6_sharding(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    check(got, 24)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_nulls_repeats_clashing_names(spark, law):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sharding.shard_documents(docs, 5, law)
    assert sorted(got.columns) == sorted([*docs.columns, "slot"])
    rows = [{"shard": r["shard"], "slot": r["slot"], "size": len((r["text"] or "").encode()) + 8} for r in got.collect()]
    assert len(rows) == len(ROWS)
    check(rows, 5, law)


def test_hot_group_is_cut(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(400)] + [(1000 + i, f"other {i}") for i in range(400)], "doc_id long, text string")
    check(sharding.op6_sharding(docs, 8).collect(), 8)


def test_many_ranges_agree_with_one(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("doc_id", "text")
    one = {tuple(r) for r in sharding.op6_sharding(docs, 3).collect()}
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 2)
    assert {tuple(r) for r in sharding.op6_sharding(docs, 3).collect()} == one


def test_empty(spark):
    assert sharding.op6_sharding(spark.createDataFrame([], SCHEMA)).count() == 0
