"""Tokenizer and attention steps hold and shuffle no more than their bounds, with the results of the plain forms."""

from collections import Counter

import numpy as np
import pyarrow as pa
from memlake.operators import numeric
from pyspark.sql import functions as F


def test_attention_sends_a_row_to_a_fixed_number_of_blocks(spark):
    n = 20_000
    at = np.random.default_rng(0).permutation(n) * 1000
    x = np.random.default_rng(1).normal(size=(n, 2)).round(3)
    rows = spark.createDataFrame([(int(i), v) for i, v in zip(at, x.tolist(), strict=True)], "i long, x array<double>").repartition(4)
    got = numeric.causal_attention(rows, 1)
    found = {r["i"]: r["y"] for r in got.collect()}
    assert len(found) == n
    for i in (0, 1000, 7_777_000, 19_999_000):
        own, past = x[at == i][0], x[at <= i]
        w = np.exp(past @ own)
        assert abs(found[i] - w @ past[:, 0] / w.sum()) < 2e-9


def test_portions_hold_all_texts_in_bounded_slices():
    texts = pa.array(["a" * 10, None, "b" * 100, "", "ç" * 30, "d"])
    for size in (1, 40, 1000):
        parts = list(numeric.portions(texts.slice(1), size))
        assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()[1:]
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= size for p in parts)


def test_encoded_gives_a_batch_in_portions(spark):
    """Ten texts of 300,000 characters in one batch: at most four in a list at once."""
    texts = spark.range(10).select("id", F.repeat(F.lit("the end "), 37_500).alias("text")).coalesce(1)
    got = texts.select("id", "text", numeric.encoded(F.col("text"), [("t", "h"), ("th", "e"), ("e", "n")]).alias("t"))
    assert got.where(F.array_join("t", "") == F.col("text")).count() == 10
    assert got.select(F.size("t")).distinct().count() == 1


def test_merges_are_those_of_counting_all_words_anew(spark):
    rng = np.random.default_rng(3)
    made = Counter("".join(rng.choice(list("abcd"), size=rng.integers(1, 9), p=[0.5, 0.3, 0.15, 0.05])) for _ in range(600))
    want: list = []
    for _ in range(12):
        pairs: Counter = Counter()
        for w, n in made.items():
            s = numeric.encode(w, {m: k for k, m in enumerate(want)})
            for p in zip(s, s[1:], strict=False):
                pairs[p] += n
        want.append(min(pairs, key=lambda p: (-pairs[p], p)))
    words = spark.createDataFrame(list(made.items()), "word string, n long")
    assert numeric.train_merges(words, 12) == want
    # Each round reads only the words that hold the merge: their change is the difference of the whole counts.
    counts = lambda merges: {(r[0], r[1]): r[2] for r in numeric.pair_changes(words, None, merges).collect()}
    change = {(r[0], r[1]): r[2] for r in numeric.pair_changes(words.where(F.contains("word", F.lit("".join(want[1])))), want[:1], want[:2]).collect()}
    a, b = counts(want[:1]), counts(want[:2])
    assert {p: n for p, n in change.items() if n} == {p: b.get(p, 0) - a.get(p, 0) for p in a | b if b.get(p, 0) != a.get(p, 0)}
