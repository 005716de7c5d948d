"""The fact store: an append-only log of writes and the views over it.

A log row is (key, content, ts_ms, seq, ttl_ms, fact_type, tags, importance). The current value of a key is
its last write; a fact is expired once ``now`` is past ts_ms + ttl_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fixed instant that the queries take as now: 2024-01-31T00:00:00Z.
NOW = 1706659200000
DAY = 86_400_000
FACT_COLUMNS = ["key", "content", "ts_ms", "seq", "ttl_ms", "fact_type", "tags", "importance"]


def facts_from_events(events: DataFrame) -> DataFrame:
    """The log of the events table: one write to (event type, user) for each event."""
    t = F.col("event_type")
    return events.select(
        F.concat_ws(":", t, F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("content"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_id").alias("seq"),
        F.when(t == "view", 7 * DAY).when(t == "click", 14 * DAY).when(t == "error", 3 * DAY).when(t == "signup", 30 * DAY).cast("long").alias("ttl_ms"),
        F.lit("json").alias("fact_type"),
        F.array(t, F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))).alias("tags"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("importance"),
    )


def is_live(now: int = NOW) -> Column:
    """Strictly past its time a fact is expired; without one it never is."""
    return F.col("ttl_ms").isNull() | (F.lit(now) <= F.col("ts_ms") + F.col("ttl_ms"))


def latest(log: DataFrame) -> DataFrame:
    """The last write of each key by (ts_ms, seq); a partial maximum on each side of the shuffle, no sort."""
    rest = [c for c in log.columns if c != "key"]
    order = F.struct(F.col("ts_ms"), F.coalesce(F.col("seq"), F.lit(0)).alias("s"))
    return log.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("w")).select("key", *[F.col(f"w.{c}").alias(c) for c in rest])


def live(log: DataFrame, now: int = NOW) -> DataFrame:
    return latest(log).where(is_live(now))


def newest(facts: DataFrame, n: int) -> DataFrame:
    """The n newest facts with their place ``rn`` (from 1), by ts_ms, seq and key."""
    top = facts.orderBy(F.desc("ts_ms"), F.desc(F.coalesce("seq", F.lit(0))), "key").limit(n)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("ts_ms"), F.desc(F.coalesce("seq", F.lit(0))), "key")))


def with_tag(facts: DataFrame, tag: str) -> DataFrame:
    return facts.where(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def keep_most_important(facts: DataFrame, cap: int, now: int = NOW) -> DataFrame:
    """What a store of ``cap`` facts keeps: expired ones go first, then the least important, then the oldest."""
    order = [F.desc("alive"), F.desc(F.coalesce("importance", F.lit(0.5))), F.desc("ts_ms"), F.desc(F.coalesce("seq", F.lit(0))), F.asc("key")]
    return facts.withColumn("alive", is_live(now)).orderBy(*order).limit(cap).drop("alive")


def merge_import(store: DataFrame, incoming: DataFrame, now: int = NOW, overwrite: bool = False) -> DataFrame:
    """The store after an import. An incoming fact wins if it is newer than a live fact of its key, or if there is none.

    With ``overwrite`` it always wins. Both sides have one row for each key.
    """
    pack = lambda df, name: df.select("key", F.struct(*FACT_COLUMNS[1:]).alias(name))
    both = pack(store, "a").join(pack(incoming, "b"), "key", "full_outer")
    alive = F.col("a.ttl_ms").isNull() | (F.lit(now) <= F.col("a.ts_ms") + F.col("a.ttl_ms"))
    wins = F.col("b").isNotNull() & (F.lit(overwrite) | F.col("a").isNull() | ~alive | (F.col("b.ts_ms") > F.col("a.ts_ms")))
    return both.withColumn("w", F.when(wins, F.col("b")).otherwise(F.col("a"))).select("key", *[F.col(f"w.{c}").alias(c) for c in FACT_COLUMNS[1:]])


def forget(log: DataFrame, keys: DataFrame) -> DataFrame:
    return log.join(keys.select("key"), "key", "left_anti")


def write_snapshot(facts: DataFrame, path: str) -> None:
    """Live facts as JSON lines; times and order aren't kept."""
    facts.select("key", "content", "tags", "importance").write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows without a key or content, and corrupt rows, are left out."""
    schema = "key string, content string, tags array<string>, importance double"
    return spark.read.schema(schema).json(path).where("key is not null and content is not null")


def trust(importance: Column, ts_ms: Column, now: int = NOW) -> Column:
    """Importance, half of which decays with a half-life of 30 days; without a time it doesn't decay."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(importance, F.lit(0.5))))
    age = F.greatest(F.lit(0), F.lit(now) - ts_ms) / F.lit(30.0 * DAY)
    return F.when(ts_ms.isNull(), clamped).otherwise(clamped * (0.5 + 0.5 * F.pow(F.lit(2.0), -age)))
