"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Each bit gets a non-zero vector of r + 1 bits; the mask of a vector v keeps the
bits whose vector has an odd product with v. For any r differing bits some v is orthogonal to all their
vectors, so every pair within the radius r agrees under one of the 2^(r+1) - 1 masks: no pair is missed.

Only distinct fingerprints are compared. A bucket of more than BUCKET fingerprints isn't paired: the bits
that its mask leaves free are covered again in the same way, which keeps the guarantee; after three rounds at
most six bits are free, so no bucket can hold more than 64 distinct fingerprints and no cap is needed.

A fingerprint's distance bounds no Jaccard similarity, so the pipeline's stage doesn't use it: ``keep_one`` joins
the shingle sets themselves by their prefixes. Sets of similarity 0.8 share four fifths of either, hence one of the
first n - ceil(0.8 n) + 1 shingles of both in any one order; pairs that do are confirmed on the whole sets.
"""

from __future__ import annotations

from functools import cache
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, fresh, short_batches, turn_to, written

#: The most fingerprints of a bucket that are compared pair by pair.
BUCKET = 64
#: Shingles are ordered by how many of these sampled documents have them (order moves cost only, never a result).
ORDER_DOCS, ORDER_SHARE, ORDER_MOST = 4096, 1 / 64, 1_000_000
#: Common shingles of two short prefixes, and the chance that a pair of similarity 0.8 has fewer.
MEET, UNLIKELY = 4, 2.0**-56
#: Keys of candidates, and shared shingles with one of their sets, that are broadcast (under 20 MB); more are joined by a shuffle.
BROADCAST_KEYS = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text, repeats included; none without words.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, with
    A-Z lower-cased; shingles are ``width`` words. Fewer words are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, max(1, len(words) - width + 1))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text, unsigned: a bit is 1 if set in over half of its shingles' hashes; without words 0."""
    h = shingle_hashes(text, width)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = h[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, width: int = 3) -> Column:
    """The fingerprint as a bigint (the same 64 bits)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        turn_to("neardup")
        values = np.array([fingerprint(t, width) for t in texts.to_pylist()], np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    return of(text)


def hex16(bits: Column) -> Column:
    """16 lower-case hex digits of a bigint."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def covering(bits: list[int], radius: int) -> list[list[int]]:
    """Kept bits of each mask that covers ``bits``; the vectors are dealt evenly, so masks are alike in size."""
    last = (1 << (radius + 1)) - 1
    vector = {b: k % last + 1 for k, b in enumerate(bits)}
    return [[b for b in bits if bin(vector[b] & v).count("1") % 2] for v in range(1, last + 1)]


def masks(radius: int) -> list[list[tuple[int, int, int]]]:
    """By round: (number, parent's number, mask) of the covering of each parent's free bits."""
    rounds, parents = [], [(0, 0)]
    while True:
        made = []
        for number, mask in parents:
            free = [b for b in range(64) if not mask >> b & 1]
            for kept in covering(free, radius):
                made.append((len(made), number, mask | sum(1 << b for b in kept)))
        rounds.append(made)
        parents = [(k, m) for k, _, m in made]
        if max(64 - bin(m).count("1") for _, m in parents) <= BUCKET.bit_length() - 1:
            return rounds


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs a < b of the distinct, non-null bigints in column fp that differ in at most ``radius`` bits.

    Every such pair, once each; no pair of equal values. An empty table gives none.
    """
    rounds = masks(radius)
    found = None
    todo = prints.select("fp", F.lit(0).alias("parent"))
    for k, made in enumerate(rounds):
        by_parent: dict[int, list[tuple[int, int]]] = {}
        for number, parent, mask in made:
            by_parent.setdefault(parent, []).append((number, _signed(mask)))
        size = len(next(iter(by_parent.values())))
        table = F.array(*[F.array(*[F.lit(m).cast("long") for _, m in by_parent[p]]) for p in sorted(by_parent)])
        # Masks of a parent are numbered in a row, so its number and the place give the mask's number.
        split = todo.select("fp", "parent", F.posexplode(F.get(table, F.col("parent"))).alias("at", "mask")).select(
            "fp", (F.col("parent") * size + F.col("at")).alias("number"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
        held = Window.partitionBy("number", "key")
        buckets = written(split.withColumn("n", F.count("*").over(held)).where("n > 1"), "buckets")
        small = buckets.where(F.col("n") <= BUCKET).select("fp", "number", "key")
        a, b = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
        pairs = a.join(b, ["number", "key"]).where(
            (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        ).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        todo = buckets.where(F.col("n") > BUCKET).select("fp", F.col("number").alias("parent"))
        if k + 1 == len(rounds) or todo.isEmpty():
            break
    return found.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) for every node of the edges (a, b), by large and small stars.

    Each round writes its edges to the shared folder; nothing but their number and a checksum comes to the
    driver. Rounds grow as the logarithm of the longest chain.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(most_rounds if state[0] else 0):
        # Large star: each node hangs its larger neighbours on its smallest neighbour.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: each node hangs its smaller neighbours and itself on the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
        now = written(small.where("a < b").distinct(), "edges")
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp (bigint SimHash), component_id (smallest doc_id reachable over links) of every row.

    Documents link if their fingerprints differ in at most ``radius`` bits. Null and wordless texts have the
    fingerprint 0 and link like any other. Repeated rows stay; a null doc_id is never a component_id unless
    the component has no other.
    """
    short_batches(docs.sparkSession)
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash(F.col("text"), width).alias("fp")), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    root = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _identity(h: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(h.tobytes(), 42))


def shingle_set(text: Column, width: int) -> Column:
    """A struct of key (a bigint that names the set) and shingles (its hashes, ascending as unsigned)."""

    @F.arrow_udf("struct<key: long, shingles: array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        turn_to("neardup")
        sets = [np.unique(shingle_hashes(t, width)) for t in texts.to_pylist()]
        keys = pa.array([_identity(h) for h in sets], pa.int64())
        return pa.StructArray.from_arrays([keys, _lists(sets)], ["key", "shingles"])

    return of(text)


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in at least three documents of a sample, ascending, and in how many."""
    n = docs.count()
    some = docs.sample(min(1.0, max(ORDER_DOCS / max(n, 1), ORDER_SHARE)), 42).select(shingle_set(F.col("text"), width).alias("s"))
    counts = some.select(F.explode("s.shingles").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 2")
    got = counts.orderBy(F.desc("c"), "h").limit(ORDER_MOST).toArrow()
    h, c = got.column("h").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


@cache
def enough(percent: int) -> int:
    """The least k of which fewer than MEET are common with a chance of at most UNLIKELY, if each is not with ``percent``."""
    q, k = percent / 100, MEET
    while sum(comb(k, i) * (1 - q) ** i * q ** (k - i) for i in range(MEET)) > UNLIKELY:
        k += 1
    return k


def prefix(h: np.ndarray, often: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, bool]:
    """The first shingles of a set (hashes ascending) in the order of all sets, and whether it is the short form.

    Frequent shingles (``often``, ascending, with ``count``) come last, the others by hash. Sets of similarity 0.8
    share one of the first n - ceil(0.8 n) + 1 of either. They differ in a quarter of n at most, so if that is
    ``percent`` of the shingles that aren't frequent, whose order is random, MEET of the first enough(percent) are
    common, but for a chance of UNLIKELY: of a long set those suffice.
    """
    n = len(h)
    rank = np.zeros(n, np.int64)
    if len(often) and n:
        at = np.minimum(np.searchsorted(often, h), len(often) - 1)
        rank = np.where(often[at] == h, count[at], 0)
    most, free = n + (-4 * n) // 5 + 1, int((rank == 0).sum())
    percent = -(-25 * n // free) if free else 100
    k = enough(percent) if percent <= 60 else most
    return h[np.lexsort((h, rank))][: min(k, most)], k < most


def _close(a: str, b: str) -> Column:
    """Sizes allow the similarity; so do the places in prefixes, if the shingle is the first that both have."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    room = F.least(n - F.col(f"{a}.at"), m - F.col(f"{b}.at"))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * room >= 4 * (n + m))


def _candidates(met: DataFrame) -> DataFrame:
    """a, b of the pairs of met.a and met.b that share enough of their prefixes."""
    pairs = met.where(_close("a", "b")).groupBy(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    return pairs.agg(F.count("*").alias("m"), F.min(F.col("a.wide") & F.col("b.wide")).alias("w")).where(f"m >= {MEET} or not w").select("a", "b")


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if they are at most BROADCAST_KEYS."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _similar(x: Column, y: Column) -> Column:
    """Whether two arrays of different bigints have a Jaccard similarity of 0.8 or more."""

    @F.arrow_udf("boolean")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        turn_to("neardup")
        out, (p, q), (i, j) = [], (c.values.to_numpy() for c in (x, y)), (c.offsets.to_numpy() for c in (x, y))
        for k in range(len(x)):
            u, v = p[i[k] : i[k + 1]], q[j[k] : j[k + 1]]
            common = len(np.intersect1d(u, v, assume_unique=True))
            out.append(5 * common >= 4 * (len(u) + len(v) - common))
        return pa.array(out, pa.bool_())

    return of(x, y)


def _confirmed(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets have a similarity of 0.8 or more, written; the sets aren't kept."""
    return alone(docs.sparkSession, "similar", lambda: _compared(docs, rows, pairs, width))


def _compared(docs: DataFrame, rows: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    asked = written(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct(), "asked")
    texts = rows.join(_few(asked), "key", "left_semi").groupBy("key").agg(F.min("text_key").alias("text_key")).select("text_key")
    texts = _few(written(texts.distinct(), "asked-texts"))
    # One text of each set is hashed again; of copies of it, one set leaves each task.
    whole = docs.select("text", _text_key().alias("text_key")).join(texts, "text_key", "left_semi")
    whole = whole.select(shingle_set(F.col("text"), width).alias("s")).select("s.key", "s.shingles")
    whole = written(whole.groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")
    both = pairs.join(whole.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(whole.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(_similar(F.col("x"), F.col("y"))).select("a", "b")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similar_sets(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """doc_id, key of every row, key naming its shingle set; and node, root: the class of every set that has a link.

    Sets link at a Jaccard similarity of 0.8 or more, confirmed on the whole sets. Each shared shingle's sets are
    first compared with one of them, so that copies become classes by a star and not by all pairs; then sets of
    different classes that share one are. Only pairs within a class are left out, so no link is lost, but for
    chance collisions of 64-bit hashes and the chance that ``prefix`` names.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sent = spark.sparkContext.broadcast(_frequent(docs, width))

    @F.arrow_udf("struct<key: long, n: long, wide: boolean, prefix: array<long>>")
    def prefixed(texts: pa.Array) -> pa.Array:
        turn_to("neardup")
        sets = [np.unique(shingle_hashes(t, width)) for t in texts.to_pylist()]
        made = [prefix(h, *sent.value) for h in sets]
        columns = [pa.array(map(_identity, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([w for _, w in made], pa.bool_())]
        return pa.StructArray.from_arrays([*columns, _lists([p for p, _ in made])], ["key", "n", "wide", "prefix"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), prefixed(F.col("text")).alias("p"))
    made = written(made.select("doc_id", "text_key", "p.*"), "prefixes")
    rows = made.select("doc_id", "text_key", "key")
    sets = made.groupBy("key").agg(F.first(F.struct("n", "wide", "prefix")).alias("p")).select("key", "p.*")
    split = sets.select("key", "n", "wide", F.posexplode("prefix").alias("at", "shingle"))
    split = split.select("shingle", F.struct("key", "n", "wide", "at").alias("a"))
    # One shuffle and a spillable sort, where a count joined to what was counted would take two.
    held = Window.partitionBy("shingle")
    shared = split.select("shingle", F.min("a").over(held).alias("b"), "a", F.count("*").over(held).alias("held"))
    shared = written(shared.where("held > 1").drop("held"), "entries")
    asked = written(_candidates(shared.where("a.key != b.key")), "candidates")
    links = _confirmed(docs, rows, asked, width)
    root = components(links).withColumnRenamed("node", "key")
    classed = shared.select("shingle", "a.key", "a").join(root, "key", "left").select("shingle", "a", F.coalesce("root", "key").alias("root"))
    mixed = classed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle")
    left = written(classed.join(_few(written(mixed, "mixed")), "shingle", "left_semi"), "classed")
    right = left.select("shingle", F.col("a").alias("b"), F.col("root").alias("other"))
    pairs = _candidates(left.join(right, "shingle").where("a.key < b.key and root != other"))
    known = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _confirmed(docs, rows, written(pairs.join(known, ["a", "b"], "left_anti"), "candidates"), width)
    return rows.select("doc_id", "key"), components(links.union(more)) if not more.isEmpty() else root.withColumnRenamed("key", "node")


def similar_components(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over links of similarity 0.8 or more) of every row."""
    rows, root = similar_sets(docs, width)
    root = root.withColumnRenamed("node", "key")
    rooted = written(rows.join(root, "key", "left").select("doc_id", F.coalesce("root", "key").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with its smallest doc_id, columns unchanged.

    Documents link if the Jaccard similarity of their sets of ``width``-word shingles is 0.8 or more; texts
    without words are alike. Rows that repeat a doc_id are one document; if it stays, its row with the smallest
    hash of all columns does. Rows without a doc_id can't be named as copies of others and all stay.
    """
    near = alone(docs.sparkSession, "near", lambda: similar_components(docs, width).where("doc_id is not null"))
    ids = near.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_semi").select(*docs.columns)
    if not near.groupBy("doc_id").count().where("count > 1").isEmpty():
        pick, rank = fresh(docs, "_pick"), fresh(docs, "_rank")
        one = Window.partitionBy("doc_id").orderBy(pick)
        kept = kept.withColumn(pick, F.xxhash64(*docs.columns)).withColumn(rank, F.row_number().over(one))
        kept = kept.where(F.col(rank) == 1).select(*docs.columns)
    return kept.union(docs.where(F.col("doc_id").isNull()))


def op10_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
