"""Searches make no larger matrix than a tile, ask any number of queries and shuffle no pairs."""

import numpy as np
import pytest
from memlake import plans
from memlake.operators import rank
from pyspark.sql import functions as F


def made(spark, n, dim=4, seed=0):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))], "id long, vec array<double>")


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["dense", "bm25"])
def test_scores_come_in_tiles(spark, kind):
    if kind == "dense":
        vecs = made(spark, 3000).coalesce(1)
        scorer = rank.dense_scorer(vecs, vecs.where("id < 1000").select(F.col("id").alias("qid"), "vec"))
    else:
        docs = spark.range(3000).select("id", F.concat(F.lit("w"), F.col("id") % 7).alias("text")).coalesce(1)
        asks = spark.range(1000).select(F.col("id").alias("qid"), F.concat_ws(" ", F.lit("w3"), F.concat(F.lit("x"), "id")).alias("text"))
        scorer = rank.bm25_scorer(docs, asks)
    score, most = scorer.score, 1 << 21

    def seen(model, batch):
        s = score(model, batch)
        if s.size > most:
            raise ValueError(f"a matrix of {s.size} numbers")
        return s

    scorer.score = seen
    assert scorer.best(2).count() == 2000


def test_best_keeps_the_smallest_ids_of_ties():
    rng, k = np.random.default_rng(1), 3
    score, ids = rng.integers(0, 4, size=(5, 400)) / 4 + rng.normal(size=(5, 400)) * 1e-12, rng.permutation(400)
    score[0, 2:] = -np.inf
    held = rank.Best(np.arange(5), k)
    for at in range(0, 400, 37):
        held.add(score[:, at : at + 37], ids[at : at + 37])
    got = held.batch().to_pandas().groupby("qid")["id"].apply(list)
    for j in range(5):
        want = sorted((-round(s, 9), i) for s, i in zip(score[j], ids, strict=True) if s > -np.inf)[:k]
        assert got[j] == [i for _, i in want]


def test_dense_topk_batch_asks_more_than_a_block(spark, tmp_path):
    made(spark, 5001, 2).select((F.col("id") * 50).alias("vec_id"), F.col("vec").alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plans.QUERIES["dense_topk_batch"](spark, str(tmp_path)).count() == 50010


def test_ann_reaches_nine_of_ten_without_a_join(spark):
    vecs = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = vecs.where("id % 5 = 0").select(F.col("id").alias("qid"), "vec")
    found, exact = rank.ann_top(vecs, asked, 10), pairs(rank.dense_top(vecs, asked, 10))
    assert "Join" not in plan(found) and len(pairs(found) & exact) >= 0.9 * len(exact)


def test_semantic_lookup_joins_nothing(spark, sf):
    assert "Join" not in plan(plans.QUERIES["semantic_lookup"](spark, sf))
    rows = [(1, 0, [1.0, 0.0, 5.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, 0, None), (6, 0, [0.0, 0.0])]
    held = [(7, 0, [2.0, 0.0]), (8, 0, [3.0, 4.0]), (9, None, [1.0, 1.0]), (10, 0, None)]
    frames = [spark.createDataFrame(r, "id long, key int, vec array<float>") for r in (rows, held)]
    for block in (1, 20_000):
        assert {r["id"]: r["score"] for r in rank.nearest_held(*frames, block).collect()} == {1: 1.0, 2: 0.8, 5: None, 6: 0.0}


def test_overlap_top_is_exact_beyond_the_documents_counted_first(spark):
    rng = np.random.default_rng(2)
    words = lambda n, most: sorted({f"w{int(most * x**3)}" for x in rng.random(n)})
    docs, asks = [(i, words(int(rng.integers(1, 40)), 90)) for i in rng.permutation(400).tolist()], [(q, words(int(rng.integers(1, 14)), 100)) for q in range(120)]
    for given in (docs, [*docs, (docs[0][0], docs[1][1]), docs[2]]):
        want = set()
        for q, t in asks:
            both = {}
            for i, w in given:
                both[i] = both.get(i, 0) + len(set(w) & set(t))
            want |= {(q, i, n, r) for r, (n, i) in enumerate(sorted((-n, i) for i, n in both.items() if n >= 2)[:3], 1) for n in [-n]}
        frames = spark.createDataFrame(given, "id long, t array<string>"), spark.createDataFrame(asks, "qid long, t array<string>")
        for block, first in ((1000, 10), (50, 25), (1000, 8192)):
            got = rank.overlap_top(*frames, block=block, first=first)
            assert "Join" not in plan(got) and {tuple(r) for r in got.collect()} == want
    assert rank.overlap_top(frames[0], frames[1].limit(0)).count() == 0 == rank.overlap_top(frames[0].limit(0), frames[1]).count()
