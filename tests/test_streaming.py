import pytest

pytest.importorskip("pyspark.sql.streaming")

from memlake.operators import belief, caches  # noqa: E402
from memlake.streaming import state  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def parts(spark, df, path, n=3):
    """The table as n files that come one after another, in the order of ord."""
    cuts = df.approxQuantile("ord", [k / n for k in range(1, n)], 0)
    low = None
    for high in [*cuts, None]:
        part = df
        if low is not None:
            part = part.where(F.col("ord") > low)
        if high is not None:
            part = part.where(F.col("ord") <= high)
        part.coalesce(1).write.mode("append").parquet(path)
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_commits_in_a_stream_equal_the_batch(spark, sf, tmp_path):
    claims = belief.claims_from_events(spark.read.parquet(f"{sf}/events.parquet"))
    out = f"{tmp_path}/out"
    state.run_available(state.commit_stream(parts(spark, claims, f"{tmp_path}/in")), out)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, belief.commit(claims).collect())) and len(got) == claims.count()


def test_limits_in_a_stream_equal_the_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    hits = e.select(F.col("user_id").cast("string").alias("caller"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    out = f"{tmp_path}/out"
    state.run_available(state.limit_stream(parts(spark, hits, f"{tmp_path}/in"), 86_400_000, 2), out)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, caches.rate_limit(hits, 86_400_000, 2).collect()))


def test_windows_count_every_event(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ord", F.col("event_id"))
    stream = parts(spark, e, f"{tmp_path}/in")
    q = state.activity_stream(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("activity").agg(F.sum("n")).first()[0] == e.count()
