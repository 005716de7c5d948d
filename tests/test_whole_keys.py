from memlake import plans


def test_lru_cache_sim_keys_by_the_whole_prompt(spark, tmp_path):
    said = ["the first", "the second", "the first", "the second "]
    rows = [(4, 2 * k, "user", t) for k, t in enumerate(said)] + [(4, 1, "assistant", "the first")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["lru_cache_sim"](spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["hit"]) for r in got] == [(400, False), (402, False), (404, True), (406, False)]
