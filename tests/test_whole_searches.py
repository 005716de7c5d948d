from memlake import plans
from memlake.operators import rank
from pyspark.sql import functions as F


def test_searches_without_sql_ask_every_query(spark, sf):
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    ids = {r["id"] for r in vecs.select("id").collect()}
    items = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id").collect()}
    for name, want in (("mmr_rerank", {i for i in ids if i % 50 == 0}), ("ann_topk_recall", {i for i in ids if i % 50 == 0}), ("hybrid_retrieve", items & ids)):
        assert len(want) > 5 and {r["qid"] for r in plans.QUERIES[name](spark, sf).select("qid").distinct().collect()} == want
    asked = vecs.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    whole = rank.dense_top(vecs, asked, 5).collect()
    parts = rank.in_blocks(asked, lambda q: rank.dense_top(vecs, q, 5), block=3).collect()
    assert len(whole) == 5 * asked.count() and sorted(whole) == sorted(parts)
