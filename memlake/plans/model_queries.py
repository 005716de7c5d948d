"""Byte formats, forward passes, tokenizer files and approximate search."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..operators import formats, models, numeric, rank
from .catalogue import query, table


def emb(s, d):
    return table(s, d, "embeddings")


for _name, _way in (("safetensors_roundtrip", "safetensors"), ("delta_bytes_roundtrip", "delta"), ("package_roundtrip", "package")):

    def _trip(s, d, way=_way):
        return emb(s, d).select("vec_id", formats.survives(F.col("embedding"), way).alias("same"))

    query(_name, "SELECT vec_id, true AS same FROM embeddings")(_trip)


@query("affect_step")
def _(s, d):
    rng = np.random.default_rng(1)
    made = models.affect_step(F.slice("embedding", 1, 8), F.slice("embedding", 9, 4), rng.normal(size=(6, 12)), rng.normal(size=(8, 6)), np.zeros(6))
    return emb(s, d).select("vec_id", made.alias("state"))


@query("moe_forward")
def _(s, d):
    rng = np.random.default_rng(2)
    up, down = rng.normal(size=(4, 16, 64)), rng.normal(size=(4, 64, 16))
    made = models.mixture(F.col("embedding"), rng.normal(size=(4, 64)), up, down, (up[0], down[0]))
    return emb(s, d).select("vec_id", made.alias("y"))


@query("lora_delta", "SELECT vec_id, round(2.0::double * (embedding[1]::double + embedding[2]::double), 6) AS first FROM embeddings")
def _(s, d):
    a, b = np.zeros((1, 64)), np.zeros((64, 1))
    a[0, :2], b[0, 0] = 1, 1
    return emb(s, d).select("vec_id", F.round(F.get(models.low_rank(F.col("embedding"), a, b, 2.0), F.lit(0)), 6).alias("first"))


@query("lm_next_token")
def _(s, d):
    ids = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 7), lambda i: ((F.col("doc_id") + i * 5) % 50).cast("int"))
    return table(s, d, "documents").select("doc_id", models.causal_forward(ids, np.random.default_rng(3).normal(size=(50, 16))).alias("next"))


@query("byte_map", "SELECT i AS byte, CASE WHEN (i BETWEEN 33 AND 126) OR (i BETWEEN 161 AND 172) OR i >= 174 THEN i WHEN i <= 32 THEN 256 + i WHEN i <= 160 THEN 256 + i - 94 ELSE 323 END AS code FROM range(256) r(i)")
def _(s, d):
    """Printable bytes stand for themselves, the others for code points from 256 on, in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
    return s.createDataFrame([(b, moved.get(b, b)) for b in range(256)], "byte long, code long")


@query("vocab_lookup", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w IN ('the', 'of', 'and', 'de', 'der'))) AS known FROM documents")
def _(s, d):
    vocabulary = F.array(*map(F.lit, ["the", "of", "and", "de", "der"]))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.array_contains(vocabulary, w))
    return table(s, d, "documents").select("doc_id", F.size(words).cast("long").alias("known"))


@query("tokenizer_import", "SELECT * FROM (VALUES (0, 't', 'h'), (1, 'th', 'e')) m(rank, left_part, right_part)")
def _(s, d):
    """Merges from a tokenizer's JSON, whether they are strings or pairs."""
    files = s.createDataFrame([(json.dumps({"model": {"merges": ["t h", ["th", "e"]], "vocab": {"t": 0}}}),)], "content string")
    merges = F.from_json(F.get_json_object("content", "$.model.merges"), "array<string>")
    each = files.select(F.posexplode(merges).alias("rank", "m"))
    pair = F.when(F.startswith("m", F.lit("[")), F.from_json("m", "array<string>")).otherwise(F.split("m", " "))
    return each.select("rank", F.get(pair, F.lit(0)).alias("left_part"), F.get(pair, F.lit(1)).alias("right_part"))


@query("bpe_encode")
def _(s, d):
    merges = [("t", "h"), ("th", "e"), (" ", "a"), ("i", "n"), ("e", "n")]
    return table(s, d, "documents").select("doc_id", F.size(numeric.encoded(F.col("text"), merges)).alias("n_symbols"))


@query("udf_hook", "SELECT conv_id, turn, length(text) AS measure FROM conversations")
def _(s, d):
    """An injected function, here a length, over Arrow batches."""
    import pyarrow.compute as pc

    @F.arrow_udf("long")
    def measure(texts):
        return pc.cast(pc.utf8_length(texts), "int64")

    return table(s, d, "conversations").select("conv_id", "turn", measure(F.col("text")).alias("measure"))


@query("ann_topk_recall")
def _(s, d):
    v = emb(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return rank.ann_top(v, v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), 10)
