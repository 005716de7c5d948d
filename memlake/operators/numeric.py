"""Tensor, model-metric and tokenizer operators; expressions where Spark has them, numpy in Arrow batches elsewhere."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm, softmax_loss
from ..sources.tables import written

#: Letters with an optional leading space, digits, marks, white space: how text is cut before merging.
PRETOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+|_+")


def scorecard(rows: DataFrame, k: int = 5) -> DataFrame:
    """tokens, cross_entropy, perplexity, bits, top1, topk of rows (logits, target); no rows give 0, 1, 0 and 0."""
    at = F.get("logits", F.col("target"))
    above = F.size(F.filter("logits", lambda x: x > at)) + F.size(
        F.filter(F.transform("logits", lambda x, i: (x == at) & (i < F.col("target"))), lambda b: b)
    )
    each = rows.select(softmax_loss(F.col("logits"), F.col("target")).alias("ce"), above.alias("above"))
    got = each.agg(
        F.count("*").alias("tokens"), F.coalesce(F.avg("ce"), F.lit(0.0)).alias("ce"),
        F.coalesce(F.avg((F.col("above") < 1).cast("double")), F.lit(0.0)).alias("top1"), F.coalesce(F.avg((F.col("above") < k).cast("double")), F.lit(0.0)).alias("topk"),
    )
    return got.select(
        "tokens", F.round("ce", 9).alias("cross_entropy"), F.round(F.exp("ce"), 9).alias("perplexity"),
        F.round(F.col("ce") / F.log(F.lit(2.0)), 9).alias("bits"), F.round("top1", 9).alias("top1"), F.round("topk", 9).alias("topk"),
    )


def quantized(vec: Column) -> Column:
    """int8 values and their scale: max / 127, 1 for zeros; halves go up."""
    top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top == 0, 1.0).otherwise(top / 127)
    q = F.transform(vec, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / scale + 0.5).cast("int"))))
    return F.struct(scale.alias("scale"), q.alias("q"))


def fp16_bits(values: np.ndarray) -> np.ndarray:
    """Half precision by cutting the mantissa off; too large is infinite, too small is zero."""
    b = values.astype(np.float32).view(np.uint32)
    sign, exponent, mantissa = (b >> 16) & 0x8000, ((b >> 23) & 0xFF).astype(np.int64) - 127 + 15, b & 0x7FFFFF
    full = mantissa | 0x800000
    shift = np.clip(14 - exponent, 0, 31).astype(np.uint32)
    out = np.where(exponent >= 31, 0x7C00, np.where(exponent <= 0, np.where(exponent < -10, 0, full >> shift), (np.maximum(exponent, 0).astype(np.uint32) << 10) | (mantissa >> 13)))
    nan = ((b >> 23) & 0xFF == 0xFF) & (mantissa != 0)
    return (sign | np.where(nan, 0x7E00, out)).astype(np.uint16)


def fp16_roundtrip(vec: Column) -> Column:
    @F.arrow_udf("array<double>")
    def of(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fp16_bits(np.array(x, np.float32)).view(np.float16).astype(np.float64).tolist() for x in v.to_pylist()], pa.list_(pa.float64()))

    return of(vec)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's bytes."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h = 0x811C9DC5
            for b in (t or "").encode():
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            out.append(h)
        return pa.array(out, pa.int64())

    return of(text)


def rms_norm(vec: Column, eps: float = 1e-5) -> Column:
    return F.transform(vec, lambda x: x.cast("double") / F.sqrt(dot(vec, vec) / F.size(vec) + eps))


def clip_norm(vec: Column, most: float) -> Column:
    n = norm(vec)
    return F.transform(vec, lambda x: x.cast("double") * F.when(n > most, most / n).otherwise(1.0))


def nearest_centroid(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, centroid, distance: the least squared distance, ties to the smaller centroid. The codebook is small."""
    both = points.crossJoin(F.broadcast(centroids.select(F.col("id").alias("c"), F.col("vec").alias("cv"))))
    gap = F.aggregate(F.zip_with("vec", "cv", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    return both.groupBy("id").agg(F.min(F.struct(F.round(gap, 9).alias("distance"), F.col("c").alias("centroid"))).alias("m")).select("id", "m.centroid", "m.distance")


def portions(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in slices of about ``size`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, to - at)
        at = to


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over pre-tokens of all texts, counted before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in portions(batch.column(0)):
                for t in part.to_pylist():
                    counts.update(PRETOKEN.findall(t or ""))
                if len(counts) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, n: adjacent symbols over words (symbols, n)."""
    pairs = F.expr("transform(sequence(1, size(symbols) - 1), i -> struct(symbols[i - 1] as l, symbols[i] as r))")
    return words.where(F.size("symbols") > 1).select(F.explode(pairs).alias("p"), "n").groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("n"))


def pair_changes(words: DataFrame, before: list[tuple[str, str]] | None, after: list[tuple[str, str]]) -> DataFrame:
    """left, right, n: what the counts of adjacent symbols over words (word, n) gain and lose when ``after`` are the merges instead of ``before``; None: there were no counts.

    Counted in the task that reads the words, so a pair leaves it once.
    """
    sides = [(sign, {m: k for k, m in enumerate(merges)}) for sign, merges in ((-1, before), (1, after)) if merges is not None]

    def given(counts: Counter) -> pa.RecordBatch:
        pairs = [p for p, n in counts.items() if n]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([counts[p] for p in pairs], pa.int64())], ["left", "right", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for sign, ranks in sides:
                    s = encode(word, ranks) if ranks else word
                    for pair in zip(s, s[1:], strict=False):
                        counts[pair] += sign * n
            if len(counts) > 200_000:
                yield given(counts)
                counts.clear()
        yield given(counts)

    return words.select("word", "n").mapInArrow(run, "left string, right string, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def train_merges(words: DataFrame, merges: int) -> list[tuple[str, str]]:
    """The merge list of byte-pair encoding over words (word, n): the commonest pair each time, ties to the smaller.

    The distinct words are written once and their pairs counted once. A new merge has the highest rank, so it changes only
    words that hold its two symbols side by side: each of the stated number of rounds encodes those alone, before and after,
    and writes the changed counts; only the chosen pair comes to the driver.
    """
    chosen: list[tuple[str, str]] = []
    words.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    kept = written(words.select("word", "n"), "words")
    counts = written(pair_changes(kept, None, []), "pairs")
    for k in range(merges):
        best = counts.orderBy(F.desc("n"), "left", "right").first()
        if best is None or best["n"] < 2:
            break
        chosen.append((best["left"], best["right"]))
        if k + 1 < merges:
            with_it = kept.where(F.contains("word", F.lit(best["left"] + best["right"])))
            both = counts.union(pair_changes(with_it, chosen[:-1], chosen))
            counts = written(both.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
    return chosen


def encode(word: str, merges: dict[tuple[str, str], int]) -> list[str]:
    """A word's symbols after merging, lowest rank first and leftmost of those."""
    s = list(word)
    while len(s) > 1:
        ranked = [(merges.get((s[i], s[i + 1]), 1 << 30), i) for i in range(len(s) - 1)]
        rank, i = min(ranked)
        if rank == 1 << 30:
            break
        s[i : i + 2] = [s[i] + s[i + 1]]
    return s


def encoded(text: Column, merges: list[tuple[str, str]]) -> Column:
    """The merged symbols of a text's pre-tokens; joined they are the text again, but for what no pre-token takes."""
    ranks = {m: k for k, m in enumerate(merges)}

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str, list[str]] = {}
        for texts in batches:
            for part in portions(texts):
                flat, ends = [], [0]
                for t in part.to_pylist():
                    for w in PRETOKEN.findall(t or ""):
                        if w not in seen:
                            seen[w] = encode(w, ranks)
                        flat += seen[w]
                    ends.append(len(flat))
                    if len(seen) > 50_000:
                        seen.clear()
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))

    return of(text)


def chunk_text(text: str | None, size: int = 400, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[tuple[str, int, int]]:
    """(text, index, start) of chunks of at most ``size`` characters, each beginning with the tail of the one before.

    Text is cut at the first separator that occurs and, where parts stay too long, at the next; without one, hard.
    """
    text = (text or "").strip()
    if not text:
        return []
    if len(text) <= size:
        return [(text, 0, 0)]
    overlap = max(0, min(overlap, size - 1))

    def cut(part: str, seps: tuple[str, ...]) -> list[str]:
        if len(part) <= size:
            return [part]
        if not seps or seps[0] == "":
            return [part[i : i + size] for i in range(0, len(part), size)]
        out: list[str] = []
        for k, piece in enumerate(part.split(seps[0])):
            whole = (seps[0] if k else "") + piece
            if out and len(out[-1]) + len(whole) <= size - overlap:
                out[-1] += whole
            elif len(whole) > size - overlap:
                out += cut(whole, seps[1:])
            else:
                out.append(whole)
        return out

    parts = [p for p in (x.strip() for x in cut(text, separators)) if p]
    made: list[tuple[str, int, int]] = []
    for k, p in enumerate(parts):
        tail = parts[k - 1][-overlap:] if k and overlap else ""
        made.append(((tail + " " + p)[-size:] if tail else p, k, max(0, text.find(p))))
    return made


def chunks(docs: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """id, index, start, chunk of every text."""

    @F.arrow_udf("array<struct<chunk: string, index: int, start: int>>")
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("chunk", pa.string()), ("index", pa.int32()), ("start", pa.int32())]))
        return pa.array([[{"chunk": c, "index": i, "start": at} for c, i, at in chunk_text(t, size, overlap)] for t in texts.to_pylist()], kind)

    return docs.select("id", F.inline(of(F.col("text")))).select("id", "index", "start", "chunk")


def code_structure(text: Column) -> Column:
    """1 less the share of faulty brackets and quotes, 1 without any."""

    def score(t: str | None) -> float:
        stack, faults, marks, quote, skip = [], 0, 0, "", False
        for c in t or "":
            if skip:
                skip = False
            elif quote:
                skip = c == "\\"
                quote = "" if c == quote or (c == "\n" and quote != "`") else quote
            elif c in "\"'`":
                quote, marks = c, marks + 1
            elif c in "([{":
                stack.append(c)
                marks += 1
            elif c in ")]}":
                marks += 1
                if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                    faults += 1
        return 1 - min(1.0, (faults + len(stack) + bool(quote)) / max(1, marks))

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([score(t) for t in texts.to_pylist()], pa.float64())

    return of(text)


def residual_codes(frames: DataFrame, codebooks: list[list[list[float]]]) -> DataFrame:
    """id, codes (one of each level), mse of what remains, for frames (id, vec); the codebooks are broadcast."""
    books = [np.array(b, np.float64) for b in codebooks]

    @F.arrow_udf("struct<codes: array<int>, mse: double>")
    def of(v: pa.Array) -> pa.Array:
        left = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64)
        codes = []
        for book in books:
            gap = ((left[:, None, :] - book[None]) ** 2).sum(axis=2)
            own = gap.argmin(axis=1)
            left = left - book[own]
            codes.append(own)
        kept = np.stack(codes, axis=1).tolist() if codes else [[] for _ in range(len(left))]
        return pa.StructArray.from_arrays([pa.array(kept, pa.list_(pa.int32())), pa.array((left**2).mean(axis=1))], ["codes", "mse"])

    return frames.select("id", of(F.col("vec")).alias("c")).select("id", "c.codes", "c.mse")


def causal_attention(rows: DataFrame, values: int, blocks: int = 16, block_rows: int = 131_072) -> DataFrame:
    """i, y of rows (i: place from 0, x: key, query and value in one): the first of ``values`` components, weighted by exp(x . x') over all places up to i.

    Blocks of places meet in pairs and give sums that are added up, by products of a few rows at once; ties in i are rows of
    their own. A row is sent to each block once, so what is shuffled grows as the rows do while there are ``blocks``
    blocks; there are more only when a block would hold over ``block_rows`` rows.
    """
    x = rows.where("i is not null and x is not null").select(F.col("i").cast("long").alias("i"), "x")
    n = max(1, min(blocks, -(-(count := x.count()) // 1024)), -(-count // block_rows))
    cuts = sorted(set(x.approxQuantile("i", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("i"))) if cuts else F.lit(0)
    x = x.withColumn("own", own)
    asks = x.select("i", "x", F.col("own").alias("q"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("k"))
    keys = x.select("i", "x", F.explode(F.sequence(F.col("own"), F.lit(len(cuts)))).alias("q"), F.col("own").alias("k"))

    def part(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        of = lambda t: (t.column("i").to_numpy(), t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))
        if not left.num_rows or not right.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "a": pa.array([], pa.float64()), "b": pa.array([], pa.float64())})
        (i, q), (j, k) = of(left), of(right)
        a, b, v = np.zeros(len(i)), np.zeros(len(i)), np.stack([k[:, values - 1], np.ones(len(k))], axis=1)
        for at in range(0, len(i), 1024):
            for to in range(0, len(k), 1024):
                own, other = slice(at, at + 1024), slice(to, to + 1024)
                late = i[own].min() < j[other].max()
                if late and i[own].max() < j[other].min():
                    continue
                e = q[own] @ k[other].T
                np.exp(e, out=e)
                if late:
                    e[j[other] > i[own][:, None]] = 0.0
                s = e @ v[other]
                a[own] += s[:, 0]
                b[own] += s[:, 1]
        return pa.table({"i": i, "a": a, "b": b})

    pairs = (len(cuts) + 1) * (len(cuts) + 2) // 2
    asks, keys = (df.repartition(pairs, "q", "k").groupBy("q", "k") for df in (asks, keys))
    sums = asks.cogroup(keys).applyInArrow(part, "i long, a double, b double")
    return sums.groupBy("i").agg(F.round(F.sum("a") / F.sum("b"), 9).alias("y"))
