"""Cache and limiter simulations: ordered folds, one cache or caller at a time."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_hits(requests: DataFrame) -> DataFrame:
    """``hit`` for each of (cache, ord, key): whether the key was asked before, in an unlimited cache."""
    w = Window.partitionBy("cache", "key").orderBy("ord")
    return requests.withColumn("hit", F.row_number().over(w) > 1)


def _folded(rows: DataFrame, by: str, schema: str, start, take) -> DataFrame:
    """Rows sorted by (by, ord) go through ``take(state, row)`` in a stream; ``start()`` gives a group's first state."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        now, first, state = None, True, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[by] != now:
                    now, first, state = row[by], False, start()
                out.append(take(state, row))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return rows.repartition(by).sortWithinPartitions(by, "ord").mapInArrow(run, schema)


def lru(requests: DataFrame, capacity: int) -> DataFrame:
    """cache, ord, hit of a least-recently-used cache of so many keys."""

    def take(held: OrderedDict, row: dict):
        hit = row["key"] in held
        if hit:
            held.move_to_end(row["key"])
        else:
            held[row["key"]] = True
            if len(held) > capacity:
                held.popitem(last=False)
        return row["cache"], row["ord"], hit

    return _folded(requests.select("cache", "ord", "key"), "cache", "cache string, ord long, hit boolean", OrderedDict, take)


def semantic(requests: DataFrame, threshold: float = 0.92, capacity: int = 64, ttl_ms: int | None = None) -> DataFrame:
    """cache, ord, hit, score: the most similar live entry hits from the threshold up; a miss is stored, the oldest goes."""

    def take(held: list, row: dict):
        v = np.array(row["vec"] or [0.0], np.float64)
        n = np.linalg.norm(v)
        if ttl_ms is not None:
            held[:] = [e for e in held if row["ts_ms"] - e[0] <= ttl_ms]
        best = max((round(float(v @ e[1] / (n * e[2])), 9) if n and e[2] else 0.0 for e in held), default=0.0)
        hit = bool(held) and best >= threshold
        if not hit:
            held.append((row["ts_ms"], v, np.linalg.norm(v)))
            if len(held) > capacity:
                held.pop(0)
        return row["cache"], row["ord"], hit, best

    return _folded(requests.select("cache", "ord", "ts_ms", "vec"), "cache", "cache string, ord long, hit boolean, score double", list, take)


def rate_limit(hits: DataFrame, window_ms: int, most: int) -> DataFrame:
    """caller, ord, allowed: a caller's window opens with a hit and holds ``most``; the next opens once it is over."""

    def take(state: list, row: dict):
        if not state or row["ts_ms"] >= state[0]:
            state[:] = [row["ts_ms"] + window_ms, 0]
        state[1] += 1
        return row["caller"], row["ord"], state[1] <= most

    return _folded(hits.select("caller", "ord", "ts_ms"), "caller", "caller string, ord long, allowed boolean", list, take)
