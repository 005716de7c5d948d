"""Structured Streaming forms of the stateful operators: commits, expiry and rate limits.

Each keeps one state per key in the state store and shares its step with the batch form. Within a
micro-batch rows of a key are taken in the order of (ts, seq); a later batch goes on from the state it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.belief import step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Commits(StatefulProcessor):
    """One belief for each subject."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "content string, importance double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        content, importance = self.held.get() if self.held.exists() else (None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("ord").to_dict("records"):
            row["importance"] = None if pd.isna(row["importance"]) else row["importance"]
            verdict, content, importance = step(content, importance, row)
            out.append((key[0], row["ord"], verdict, content, importance))
        if content is not None:
            self.held.update((content, importance))
        yield pd.DataFrame(out, columns=["subject", "ord", "verdict", "held", "importance"])

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """A window for each caller that opens with a hit."""

    window_ms, most = 60_000, 10

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "reset long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        reset, n = self.open.get() if self.open.exists() else (None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("ord").to_dict("records"):
            if reset is None or row["ts_ms"] >= reset:
                reset, n = row["ts_ms"] + self.window_ms, 0
            n += 1
            out.append((key[0], row["ord"], n <= self.most))
        self.open.update((int(reset), int(n)))
        yield pd.DataFrame(out, columns=["caller", "ord", "allowed"])

    def close(self) -> None:
        pass


def commit_stream(claims: DataFrame) -> DataFrame:
    """The verdicts of a stream of claims; see belief.commit for the columns."""
    use_rocksdb(claims.sparkSession)
    return claims.groupBy("subject").transformWithStateInPandas(
        Commits(), "subject string, ord long, verdict string, held string, importance double", "Append", "None"
    )


def limit_stream(hits: DataFrame, window_ms: int, most: int) -> DataFrame:
    """Which hits of a stream are allowed; see caches.rate_limit for the columns."""
    use_rocksdb(hits.sparkSession)
    made = Limiter()
    made.window_ms, made.most = window_ms, most
    return hits.groupBy("caller").transformWithStateInPandas(made, "caller string, ord long, allowed boolean", "Append", "None")


def latest_stream(log: DataFrame) -> DataFrame:
    """The current value of each key over a stream of writes: an update-mode aggregation, so state is one row a key."""
    order = F.struct(F.col("ts_ms"), F.coalesce(F.col("seq"), F.lit(0)).alias("s"))
    return log.groupBy("key").agg(F.max_by(F.struct("content", "ts_ms", "seq", "ttl_ms"), order).alias("w")).select("key", "w.*")


def activity_stream(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out and state is dropped behind it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Works off what is there and writes it as Parquet, with its progress beside it, so that a restart goes on."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start(path).awaitTermination()
