"""Sharding by sampled splitters (native: DataFrame functions only).

Records are put in the order of (hash of text, id). A size-weighted sample of those keys gives quantile
boundaries; records are range-partitioned by them, each range is summed, and prefix sums over the ranges
tell each record how many bytes lie before it in the whole order. Its shard follows from that position, so
a range that holds more than a shard's share is subdivided at the exact byte: shard sizes differ by no more
than one record. Equal texts are neighbours in the order; a group larger than a shard is cut by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

#: Keys drawn for each range, and the most ranges: what reaches the driver is about 64 * 2048 keys of 16 bytes at most.
SAMPLE_PER_RANGE = 64
MAX_RANGES = 2048
ROWS_PER_RANGE = 50_000


def splitters(keyed: DataFrame, high: str, low: str, size: str, ranges: int, total: int) -> list[tuple[int, int]]:
    """Quantile boundaries of (high, low) from a sample in which a record's chance is its share of the bytes.

    The draw is a hash of the key, so a task that runs again draws the same records.
    """
    if ranges < 2 or total <= 0:
        return []
    want = SAMPLE_PER_RANGE * ranges
    draw = (F.pmod(F.xxhash64(F.col(high), F.col(low), F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    rate = F.col(size) * F.lit(float(want) / total)
    drawn = keyed.where(draw < rate).select(high, low, F.greatest(F.lit(1.0), rate).alias("w"))
    points = sorted((r[0], r[1], r[2]) for r in drawn.collect())
    mass, step, cuts = 0.0, sum(p[2] for p in points) / ranges, []
    for a, b, w in points:
        mass += w
        if mass >= step * (len(cuts) + 1) and len(cuts) < ranges - 1:
            if not cuts or cuts[-1] != (a, b):
                cuts.append((a, b))
    return cuts


def range_of(high: Column, low: Column, cuts: list[tuple[int, int]]) -> Column:
    """The number of cuts below (high, low): a nested choice, so log2(cuts) comparisons a record."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = cuts[mid]
        return F.when((high < a) | ((high == a) & (low <= b)), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    if len(cuts) <= 64:
        return pick(0, len(cuts))
    edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cuts])
    point = F.struct(high.alias("a"), low.alias("b"))

    # Binary search: add falling powers of two while the edge there still lies below the point.
    n = len(cuts)
    return F.aggregate(
        F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]),
        F.lit(0),
        lambda at, s: F.when((at + s <= n) & (F.get(edges, at + s - 1) < point), at + s).otherwise(at),
    )


def assign_shards(records: DataFrame, high: str, low: str, size: str, shards: int, law: str = "bytes") -> DataFrame:
    """``records`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in its shard).

    high, low: bigint columns that order the records; size: bigint weight, 0 or more.
    law ``bytes``: shard sizes differ by at most one record's size; ``rows``: counts differ by at most one.

    Nulls in high or low count as the smallest value and in size as 0; ties in both keys are ordered by a
    hash of all columns, and what is equal in every column is interchangeable. An empty table stays empty.
    Columns called shard or slot are replaced.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law is bytes or rows")
    least = -(1 << 63)
    own = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    h, l, z, t = (fresh(records, c) for c in ("_hi", "_lo", "_sz", "_tie"))
    keyed = records.select(
        *own,
        F.coalesce(F.col(high), F.lit(least)).alias(h),
        F.coalesce(F.col(low), F.lit(least)).alias(l),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias(z) if law == "bytes" else F.lit(1).cast("long").alias(z),
        F.xxhash64(*[F.col(c) for c in own]).alias(t),
    )
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum(z), F.lit(0))).first()
    ranges = max(1, min(MAX_RANGES, max(shards, -(-n // ROWS_PER_RANGE))))
    cuts = splitters(keyed, h, l, z, ranges, total)
    r, base_z, base_n = (fresh(records, c) for c in ("_range", "_base_z", "_base_n"))
    ranged = keyed.withColumn(r, range_of(F.col(h), F.col(l), cuts).cast("int"))
    sums = {row[0]: (row[1], row[2]) for row in ranged.groupBy(r).agg(F.sum(z), F.count("*")).collect()}
    at_z = at_n = 0
    offsets = []
    for k in range(len(cuts) + 1):
        offsets.append((at_z, at_n))
        at_z, at_n = at_z + sums.get(k, (0, 0))[0], at_n + sums.get(k, (0, 0))[1]
    bases_z = F.array(*[F.lit(a).cast("long") for a, _ in offsets])
    bases_n = F.array(*[F.lit(b).cast("long") for _, b in offsets])
    in_range = Window.partitionBy(r).orderBy(h, l, t)
    before, index, shard = (fresh(records, c) for c in ("_before", "_index", "_shard"))
    placed = ranged.withColumns(
        {
            before: F.sum(z).over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col(z),
            index: F.row_number().over(in_range) - 1,
        }
    ).withColumns({before: F.col(before) + F.get(bases_z, F.col(r)), index: F.col(index) + F.get(bases_n, F.col(r))})
    # The middle of a record decides; in decimal, since bytes times shards may pass a long.
    whole = F.lit(max(total, 1)).cast("decimal(20,0)")
    part = (F.col(before).cast("decimal(20,0)") * 2 + F.col(z)) * shards
    by_bytes = F.least(F.lit(shards - 1), F.floor(part / (whole * 2)).cast("int"))
    placed = placed.withColumn(shard, by_bytes)
    starts = {row[0]: row[1] for row in placed.groupBy(shard).agg(F.min(index)).collect()}
    start = F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(shards)])
    return placed.select(
        *own, F.col(shard).alias("shard"), (F.col(index) - F.get(start, F.col(shard))).cast("long").alias("slot")
    )


def shard_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 8), text_crc32 and text_hash of each document.

    A null text has the size 8, and the checksum and hash of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def shard_documents(docs: DataFrame, shards: int = 24, law: str = "bytes") -> DataFrame:
    """All columns of ``docs`` with shard and slot, to be written with ``partitionBy('shard')``."""
    h, z = fresh(docs, "_text_hash"), fresh(docs, "_size")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({h: F.xxhash64(text), z: (F.octet_length(text) + 8).cast("long")})
    return assign_shards(keyed, h, "doc_id", z, shards, law).drop(h, z)


def op6_sharding(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law ``bytes``."""
    keys = written(shard_keys(docs), "shard-keys")
    return assign_shards(keys, "text_hash", "doc_id", "size", shards, "bytes").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
