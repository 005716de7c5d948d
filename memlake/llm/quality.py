"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The features cos(w.x + b) approximate a Gaussian kernel over standardised statistics of a text. Each task
adds up its part of the normal equations; the sums (FOURIER + 1 squared numbers) are added in groups and
solved on the driver. The raw score is calibrated by isotonic regression over a histogram of BINS cells, so
neither step depends on the number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, short_batches, written

FOURIER = 256
RIDGE = 1.0
BINS = 1024
SEED = 20240
#: Kernel width, in standard deviations of the statistics.
WIDTH = 6.0
THRESHOLD = 0.3

#: letter, upper, digit, white space, sentence mark, other ASCII mark, beyond ASCII, control
_CLASS = np.full(256, 5, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[128:] = 6
_CLASS[[*range(9), *range(14, 32), 127]] = 7

STATISTICS = (
    "log_bytes lower upper digit space mark other high control word_mean word_long distinct top_word lines line_repeat "
    "line_mean bare_lines ends_well pair_repeat zip_ratio shout marks_per_word longest_run bar symbol_words".split()
)


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; null and empty texts have zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / n
    words = text.split()
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    pairs = sum(map(str.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    plain = sum(map(str.isalpha, words))
    symbol = sum(1 for w in words if not w[-1].isalnum() and not w[-1:] in ".,;:?!'\")")
    return [
        math.log1p(n), *kinds.tolist(), float(lengths.mean()), float((lengths > 15).mean()), len(counts) / m, max(counts.values(), default=0) / m,
        math.log1p(k), 1 - len(set(lines)) / k, math.log1p(n / k), sum(x[-1] not in ".!?\"')" for x in lines) / k,
        float(text.rstrip()[-1:] in tuple(".!?")), pairs / m, len(zlib.compress(raw, 1)) / n,
        sum(map(str.isupper, words)) / m, 1 - plain / m, math.log1p(float(lengths.max())), text.count("|") / m, symbol / m,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x`` (array of doubles) of every row, written once."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return written(docs.select("doc_id", of(F.col("text")).alias("x")), "statistics")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


class Model:
    """Standardisation, Fourier features, ridge weights, and the calibrated steps."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(size=(len(mean), FOURIER)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)
        self.weights = np.zeros(FOURIER + 1)
        self.edges, self.levels = np.zeros(0), np.full(1, 0.5)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * math.sqrt(2 / FOURIER), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, never falling in the raw score; within a level the raw score still tells rows apart."""
        raw = self.raw(x)
        level = self.levels[np.searchsorted(self.edges, raw, side="right")]
        return np.clip(level + 1e-6 * np.tanh(raw), 0.0, 1.0)


def isotonic(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The never falling means of cells with n rows and the sum y, by pooling adjacent violators; n is positive."""
    blocks: list[list[float]] = []
    for a, b in zip(n.tolist(), y.tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(c), s / a) for a, s, c in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """A model of ``x`` (see with_statistics) and ``label`` (0 or 1); rows with a null label teach nothing.

    Without labelled rows every score is 0.5.
    """
    rows = labelled.where("label is not null and x is not null").select("x", F.col("label").cast("double").alias("label"))
    width = len(STATISTICS)
    moments = rows.select(
        F.count("*").alias("n"),
        *[f(F.get("x", F.lit(k))).alias(f"{p}{k}") for k in range(width) for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))],
    ).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(width)])
    deviation = np.array([moments[f"s{k}"] or 0.0 for k in range(width)])
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0))
    if not moments["n"]:
        return model

    def equations(batches):
        total = np.zeros((FOURIER + 1, FOURIER + 2))
        for batch in batches:
            f = model.features(_matrix(batch.column(0), width))
            total += f.T @ np.hstack([f, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part % 16], pa.int32()), pa.array([total.ravel().tobytes()])], ["part", "sums"])

    def added(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOURIER + 1) * (FOURIER + 2))
        for t in tables:
            for x in t.column("sums").to_pylist():
                total += np.frombuffer(x, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["part", "sums"])

    sums = rows.mapInArrow(equations, "part int, sums binary")
    sums = sums.groupBy("part").applyInArrow(added, "part int, sums binary").select("sums").collect()
    both = sum(np.frombuffer(bytes(r[0]), np.float64) for r in sums).reshape(FOURIER + 1, FOURIER + 2)
    penalty = RIDGE * np.eye(FOURIER + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])

    def cells(batches):
        n, y = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            at = np.clip(((model.raw(_matrix(batch.column(0), width)) + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            y += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(y[used])], ["cell", "n", "y"])

    got = rows.mapInArrow(cells, "cell int, n double, y double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    hist = sorted(tuple(r) for r in got.collect())
    cell, n, y = (np.array(v, float) for v in zip(*hist, strict=True))
    model.levels = isotonic(n, y)
    model.edges = cell[1:] / BINS * 2 - 0.5
    return model


def scores(table: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``table`` (doc_id, x)."""
    sent = table.sparkSession.sparkContext.broadcast(model)
    width = len(STATISTICS)

    @F.arrow_udf("double")
    def of(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_matrix(x, width)))

    return table.select("doc_id", of(F.col("x")).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, teaches) -> DataFrame:
    """doc_id and score of every row of ``docs``, learned from ``labels`` (doc_id, quality) where ``teaches`` holds.

    Null and empty texts are scored like any other, by statistics of zero. A repeated label row counts again,
    a repeated document is scored again; documents without an id have no label.
    """
    table = with_statistics(docs)
    known = labels.where(teaches).select("doc_id", F.col("quality").alias("label"))
    return scores(table, fit(table.join(known, "doc_id")))


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; held out are ids whose crc32 as text is 0 modulo 5."""
    held = id_bucket(F.col("doc_id"), 5) == 0
    scored = quality(docs.select("doc_id", "text"), labels, ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
