"""Benchmark decontamination by winnowing (native: DataFrame functions only).

Of each six consecutive 5-word hashes of a text the least is kept. Any ten words in a row hold six such
hashes, so a document and an item that share ten words share a kept hash: joining the kept hashes of both
sides misses nothing. In the documents found, every window is then looked up among the items' windows, which
extends each hit to all the words that it covers, and the words themselves are compared.

Items of fewer than ten words are one window each; for them all hashes of that many words are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone, written

#: Words of a window, and of a hashed gram; windows of WINDOW - GRAM + 1 grams are winnowed.
WINDOW = 10
GRAM = 5
#: Documents that share a fingerprint are broadcast as 16-byte keys up to this many, and joined by shuffle beyond.
BROADCAST_KEYS = 500_000

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of digits, letters and anything beyond ASCII; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _BETWEEN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def grams(hashes: Column, n: int) -> Column:
    """The hash of each n in a row; ``hashes`` is bound by let()."""
    each = F.transform(hashes, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(hashes, i + k) for k in range(1, n)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def winnowed(hashes: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The distinct least gram hashes of each ``window`` words."""
    wide = window - gram + 1

    def least(g: Column) -> Column:
        each = F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, wide)])) if wide > 1 else g
        return F.array_distinct(F.slice(each, F.lit(1), F.greatest(F.size(g) - (wide - 1), F.lit(0))))

    return let(grams(hashes, gram), least)


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text; results depend on nothing else of a row."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(11), t).alias("k2")]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (string, null: empty), n, window (n words) and g (their hash), once each."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("n", F.least(F.lit(WINDOW), F.size("w")))
    parts = w.select("item", "n", F.explode(F.expr("transform(sequence(0, size(w) - n), i -> slice(w, i + 1, n))")).alias("window"))
    hashed = F.xxhash64(F.col("n"), F.transform("window", lambda x: F.xxhash64(x)))
    return parts.withColumn("g", hashed).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), spans (array of start, length) of every row of ``docs``.

    A word is hit if it lies in any occurrence of a window of an item. Null texts have no words; repeated
    rows get equal results; an empty benchmark hits nothing. Items without words can't occur; item_ids are
    compared as strings, and a null one is the empty string.
    """
    windows = written(item_windows(benchmark), "windows")
    short = sorted(r[0] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().collect())
    keep = lambda h: F.array_distinct(F.concat(winnowed(h), *[grams(h, n) for n in short]))
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    scan = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *text_key(F.col("text")),
            F.explode(F.array(words(F.col("text")))).alias("w"),
        ).select("doc_id", "k1", "k2", F.size("w").cast("long").alias("n_words"), let(hashes(F.col("w")), keep).alias("kept")),
        "fingerprints",
    )
    long_items = windows.where(F.col("n") == WINDOW).groupBy("item").agg(F.collect_set("window").alias("ws"))
    # A window of ten words is winnowed by itself: its one least hash is among those kept of any text that holds it.
    of_items = long_items.select(F.explode("ws").alias("w")).select(F.explode(let(hashes(F.col("w")), winnowed)).alias("f"))
    for n in short:
        of_items = of_items.union(
            windows.where(F.col("n") == n).select(F.explode(let(hashes(F.col("window")), lambda h, n=n: grams(h, n))).alias("f"))
        )
    hit_keys = written(
        scan.select("k1", "k2", F.explode("kept").alias("f")).join(of_items.distinct(), "f", "left_semi").select("k1", "k2").distinct(),
        "hit-keys",
    )
    small = hit_keys.count() <= BROADCAST_KEYS
    found = written(
        docs.select(*text_key(F.col("text")), "text")
        .join(F.broadcast(hit_keys) if small else hit_keys, ["k1", "k2"], "left_semi")
        .dropDuplicates(["k1", "k2"])
        .select("k1", "k2", words(F.col("text")).alias("w")),
        "hit-texts",
    )

    def windows_of(h: Column, n: int) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0)))
        g = lambda i: F.xxhash64(F.lit(n), F.slice(h, i + 1, n))
        return F.transform(starts, lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("n"), g(i).alias("g")))

    window_hashes = lambda h: F.concat(*[windows_of(h, n) for n in [*short, WINDOW]])
    at = found.select("k1", "k2", F.explode(let(hashes(F.col("w")), window_hashes)).alias("p")).select("k1", "k2", "p.*")
    distinct_windows = windows.select("n", "g", "window").distinct()
    matched = at.join(distinct_windows, ["n", "g"]).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("at", "n", "window")).alias("m")
    )
    # The words decide, not their hash.
    true = matched.join(found, ["k1", "k2"]).select(
        "k1", "k2", F.filter("m", lambda m: F.slice(F.col("w"), m["at"] + 1, m["n"]) == m["window"]).alias("m")
    )
    true = written(true.where(F.size("m") > 0), "matches")
    runs = F.array_sort(F.transform("m", lambda m: F.struct(m["at"].alias("start"), m["n"].alias("length"))))
    empty = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def merge(done: Column, run: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        length = F.greatest(last["length"], run["start"] + run["length"] - last["start"])
        longer = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), length.alias("length"))),
        )
        return F.when(last["start"] + last["length"] >= run["start"], longer).otherwise(F.concat(done, F.array(run)))

    spans = true.select("k1", "k2", F.aggregate(runs, empty, merge).alias("spans"))
    items = (
        true.select("k1", "k2", F.explode(F.array_distinct(F.transform("m", lambda m: m["window"]))).alias("window"))
        .join(windows.select("window", "item"), "window")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        scan.select("doc_id", "k1", "k2", "n_words")
        .join(spans.join(items, ["k1", "k2"]), ["k1", "k2"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["length"]), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
            F.coalesce("spans", empty).alias("spans"),
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which no word is hit, columns unchanged; rows with a null text stay."""

    def found() -> DataFrame:
        hit = contamination(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), benchmark)
        return hit.where("n_hit > 0").select(F.col("doc_id").alias("_hash")).distinct()

    bad = alone(docs.sparkSession, "contaminated", found)
    small = bad.count() <= BROADCAST_KEYS
    return docs.join(
        F.broadcast(bad) if small else bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_hash"], "left_anti"
    )


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bn AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bn),
dw AS (SELECT r, n, i, w[i:i + n - 1] AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ns WHERE len(w) >= n)),
m AS (SELECT r, dw.n, i, item FROM dw JOIN bw ON dw.win = bw.win),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, n, i FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""
