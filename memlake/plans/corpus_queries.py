"""Corpus, tokenizer, metric and tensor queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..functions.vectors import dot, norm, softmax_loss
from ..operators import numeric
from .catalogue import query, table


def emb(s, d):
    return table(s, d, "embeddings")


_D = "CAST(embedding AS DOUBLE[])"
_CE = f"(ln(list_sum(list_transform({_D}, lambda x: exp(x - list_max({_D}))))) + list_max({_D}) - {_D}[label + 1])"
_ABOVE = f"len(list_filter({_D}, lambda x: x > {_D}[label + 1])) + len(list_filter(range(label), lambda i: {_D}[i + 1] = {_D}[label + 1]))"
_CARD = f"SELECT count(*) AS tokens, round(avg(ce), 9) AS cross_entropy, round(exp(avg(ce)), 9) AS perplexity, round(avg(ce) / ln(2.0::double), 9) AS bits, round(avg((a < 1)::int), 9) AS top1, round(avg((a < 5)::int), 9) AS topk FROM (SELECT label, vec_id, {_CE} AS ce, {_ABOVE} AS a FROM embeddings)"


def logits(s, d):
    return emb(s, d).select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target"))


@query("scorecard", _CARD)
def _(s, d):
    return numeric.scorecard(logits(s, d))


@query("topk_accuracy", f"SELECT label, round(avg(({_ABOVE} < 5)::int), 9) AS top5 FROM embeddings GROUP BY label")
def _(s, d):
    at = F.get("embedding", F.col("label"))
    return emb(s, d).groupBy("label").agg(F.round(F.avg((F.size(F.filter("embedding", lambda x: x > at)) < 5).cast("double")), 9).alias("top5"))


@query("scorecard_compare", f"WITH c AS (SELECT vec_id % 2 AS side, exp(avg({_CE})) AS p FROM embeddings GROUP BY 1) SELECT round(b.p - a.p, 9) AS delta, round(b.p / a.p, 9) AS ratio, CASE WHEN abs(b.p / a.p - 1) <= 0.005 THEN 'tie' WHEN b.p < a.p THEN 'candidate' ELSE 'base' END AS winner FROM c a JOIN c b ON a.side = 0 AND b.side = 1")
def _(s, d):
    each = emb(s, d).select((F.col("vec_id") % 2).alias("side"), softmax_loss(F.col("embedding"), F.col("label")).alias("ce"))
    p = each.agg(F.exp(F.avg(F.when(F.col("side") == 0, F.col("ce")))).alias("a"), F.exp(F.avg(F.when(F.col("side") == 1, F.col("ce")))).alias("b"))
    winner = F.when(F.abs(F.col("b") / F.col("a") - 1) <= 0.005, "tie").when(F.col("b") < F.col("a"), "candidate").otherwise("base")
    return p.select(F.round(F.col("b") - F.col("a"), 9).alias("delta"), F.round(F.col("b") / F.col("a"), 9).alias("ratio"), winner.alias("winner"))


@query("seq_perplexity", f"SELECT label AS seq_id, round(exp(avg({_CE})), 9) AS perplexity FROM embeddings GROUP BY label HAVING count(*) >= 2")
def _(s, d):
    each = emb(s, d).select(F.col("label").alias("seq_id"), softmax_loss(F.col("embedding"), F.col("label")).alias("ce"))
    return each.groupBy("seq_id").agg(F.round(F.exp(F.avg("ce")), 9).alias("perplexity"), F.count("*").alias("n")).where("n >= 2").drop("n")


@query("nucleus_set", "WITH x AS (SELECT vec_id, i, exp(embedding[i + 1]::double * 20) AS e FROM embeddings, range(64) r(i)), p AS (SELECT vec_id, i, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM x), c AS (SELECT vec_id, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - p AS before FROM p) SELECT vec_id, count(*) AS kept FROM c WHERE round(before, 9) < 0.9 GROUP BY vec_id")
def _(s, d):
    x = emb(s, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.exp(F.col("x").cast("double") * 20).alias("e"))
    by = Window.partitionBy("vec_id")
    p = x.withColumn("p", F.col("e") / F.sum("e").over(by))
    c = p.withColumn("before", F.sum("p").over(by.orderBy(F.desc("p"), "i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("p"))
    return c.where(F.round("before", 9) < 0.9).groupBy("vec_id").agg(F.count("*").alias("kept"))


@query("int8_quantize", f"WITH m AS (SELECT vec_id, {_D} AS v, list_max(list_transform({_D}, lambda x: abs(x))) / 127 AS sc FROM embeddings) SELECT vec_id, round(sc, 12) AS scale, list_sum(list_transform(v, lambda x: CAST(greatest(-127, least(127, floor(x / sc + 0.5::double))) AS BIGINT))) AS total FROM m")
def _(s, d):
    q = emb(s, d).select("vec_id", numeric.quantized(F.col("embedding")).alias("z"))
    total = F.aggregate("z.q", F.lit(0).cast("long"), lambda a, x: a + x)
    return q.select("vec_id", F.round("z.scale", 12).alias("scale"), total.alias("total"))


@query("int8_per_channel", "SELECT i AS channel, round(max(abs(embedding[i + 1]::double)) / 127, 12) AS scale FROM embeddings, range(64) r(i) GROUP BY i")
def _(s, d):
    each = emb(s, d).select(F.posexplode("embedding").alias("channel", "x"))
    return each.groupBy(F.col("channel").cast("long").alias("channel")).agg(F.round(F.max(F.abs(F.col("x").cast("double"))) / 127, 12).alias("scale"))


@query("fp16_roundtrip")
def _(s, d):
    return emb(s, d).select("vec_id", numeric.fp16_roundtrip(F.col("embedding")).alias("vec"))


@query("row_delta", "SELECT vec_id AS row, 64 AS width FROM embeddings WHERE vec_id % 9 = 0")
def _(s, d):
    """Rows that differ from the base by more than 1e-6 anywhere; every ninth was changed."""
    base = emb(s, d).select("vec_id", F.col("embedding").alias("a"))
    now = emb(s, d).select("vec_id", F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x + F.lit(0.01).cast("float"))).otherwise(F.col("embedding")).alias("b"))
    moved = base.join(now, "vec_id").where(F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda g: g > 1e-6))
    return moved.select(F.col("vec_id").alias("row"), F.size("b").alias("width"))


@query("l2_norm_clip", f"SELECT vec_id, round(sqrt(list_dot_product({_D}, {_D})), 6) AS norm, round(least(sqrt(list_dot_product({_D}, {_D})), 0.5::double), 6) AS clipped FROM embeddings")
def _(s, d):
    e = emb(s, d).select("vec_id", "embedding", numeric.clip_norm(F.col("embedding"), 0.5).alias("c"))
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(norm(F.col("c")), 6).alias("clipped"))


@query("mean_pool", "SELECT label, i AS dim, round(avg(embedding[i + 1]::double), 9) AS mean FROM embeddings, range(64) r(i) GROUP BY ALL")
def _(s, d):
    x = emb(s, d).select("label", F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("mean"))


@query("rms_norm", f"SELECT vec_id, round({_D}[1] / sqrt(list_dot_product({_D}, {_D}) / 64 + 0.00001::double), 9) AS first FROM embeddings")
def _(s, d):
    return emb(s, d).select("vec_id", F.round(F.get(numeric.rms_norm(F.col("embedding")), F.lit(0)), 9).alias("first"))


@query("activations", "SELECT vec_id, round(1 / (1 + exp(-x)), 9) AS sigmoid, round(x / (1 + exp(-x)), 9) AS silu, round(ln(1 + exp(x)), 9) AS softplus, round(greatest(x, 0), 9) AS relu FROM (SELECT vec_id, embedding[1]::double AS x FROM embeddings)")
def _(s, d):
    x = F.get("embedding", F.lit(0)).cast("double")
    gate = 1 / (1 + F.exp(-x))
    return emb(s, d).select("vec_id", F.round(gate, 9).alias("sigmoid"), F.round(x * gate, 9).alias("silu"), F.round(F.log1p(F.exp(x)), 9).alias("softplus"), F.round(F.greatest(x, F.lit(0.0)), 9).alias("relu"))


_T = "(((c_acctbal::bigint % 101 + 101) % 101) - 50) / 50.0::double"


@query("setpoint", f"SELECT c_custkey, round(greatest(0.0::double, least(1.0::double, 0.5::double + 0.3::double * {_T})), 9) AS calm, round(greatest(0.0::double, least(1.0::double, 0.4::double + 0.4::double * {_T})), 9) AS exploration FROM (SELECT c_custkey, floor(c_acctbal) AS c_acctbal FROM customer)")
def _(s, d):
    t = (F.pmod(F.floor("c_acctbal"), F.lit(101)) - 50) / 50.0
    unit = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 9)
    return table(s, d, "customer").select("c_custkey", unit(0.5 + 0.3 * t).alias("calm"), unit(0.4 + 0.4 * t).alias("exploration"))


@query("clamp_state", "SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: greatest(-0.1::double, least(0.1::double, x::double)))), 9) AS total FROM embeddings")
def _(s, d):
    clamped = F.transform(F.slice("embedding", 1, 8), lambda x: F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.nanvl(x.cast("double"), F.lit(-0.1)))))
    return emb(s, d).select("vec_id", F.round(F.aggregate(clamped, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


_GATE = "r AS (SELECT label AS expert, i, avg(embedding[i + 1]::double) AS w FROM embeddings, range(64) q(i) GROUP BY ALL), l AS (SELECT vec_id, expert, round(sum(embedding[i + 1]::double * w), 9) AS logit FROM embeddings JOIN r ON true GROUP BY vec_id, expert), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, expert) AS rn FROM l QUALIFY rn <= 2), g AS (SELECT vec_id, expert, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS gate FROM t)"


def gates(s, d):
    x = emb(s, d).select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    routers = x.groupBy(F.col("label").alias("expert"), "i").agg(F.avg(F.col("x").cast("double")).alias("w"))
    # Rows of the router matrix (experts by dimensions) meet tokens on the dimension: a matrix product as a join.
    l = x.join(F.broadcast(routers), "i").groupBy("vec_id", "expert").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")), 9).alias("logit"))
    t = l.withColumn("rn", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("logit"), "expert"))).where("rn <= 2")
    return t.select("vec_id", "expert", (F.exp("logit") / F.sum(F.exp("logit")).over(Window.partitionBy("vec_id"))).alias("gate"))


@query("moe_gate", f"WITH {_GATE} SELECT vec_id, expert, round(gate, 8) AS gate FROM g")
def _(s, d):
    return gates(s, d).withColumn("gate", F.round("gate", 8))


@query("load_balance", f"WITH {_GATE} SELECT expert, count(*) AS chosen, round(sum(gate), 7) AS weight FROM g GROUP BY expert")
def _(s, d):
    return gates(s, d).groupBy("expert").agg(F.count("*").alias("chosen"), F.round(F.sum("gate"), 7).alias("weight"))


@query("causal_conv", "SELECT event_id, round(0.5::double * value + 0.3::double * coalesce(lag(value, 1) OVER w, 0) + 0.2::double * coalesce(lag(value, 2) OVER w, 0), 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(s, d, "events").select("event_id", F.round(0.5 * F.col("value") + 0.3 * F.lag("value", 1, 0.0).over(w) + 0.2 * F.lag("value", 2, 0.0).over(w), 6).alias("y"))


@query("affine_scan", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda h, x: 0.9::double * h + 0.1::double * x, 0.0::double), 6) AS h FROM events GROUP BY user_id")
def _(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.aggregate(ordered, F.lit(0.0), lambda h, x: 0.9 * h + 0.1 * x["value"]), 6).alias("h"))


@query("linear_forward", "SELECT e.vec_id, w.label AS output, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), w.v), 8) AS y FROM embeddings e CROSS JOIN (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) w")
def _(s, d):
    w = emb(s, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return emb(s, d).crossJoin(F.broadcast(w.withColumnRenamed("label", "output"))).select("vec_id", "output", F.round(dot(F.col("embedding"), F.col("v")), 8).alias("y"))


_A = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))"


@query("attention_causal", f"WITH a AS (SELECT q.vec_id AS i, k.vec_id AS j, exp({_A}) AS e, k.embedding[1]::double AS v FROM embeddings q JOIN embeddings k ON k.vec_id <= q.vec_id) SELECT i, round(sum(e * v) / sum(e), 9) AS y FROM a GROUP BY i")
def _(s, d):
    return numeric.causal_attention(emb(s, d).select(F.col("vec_id").alias("i"), F.col("embedding").alias("x")), 1)


@query("adamw_step", "SELECT vec_id, round(p - 0.001::double * (g / (abs(g) + 0.00000001::double) + 0.01::double * p), 12) AS p FROM (SELECT vec_id, embedding[1]::double AS p, embedding[2]::double AS g FROM embeddings)")
def _(s, d):
    """The first step: both moments, corrected, are the gradient itself."""
    p, g = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    return emb(s, d).select("vec_id", F.round(p - 0.001 * (g / (F.abs(g) + 1e-8) + 0.01 * p), 12).alias("p"))


@query("kmeans_assign", "WITH c AS (SELECT label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), x AS (SELECT vec_id AS id, c, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings CROSS JOIN c) SELECT id, c AS centroid, distance FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, c) = 1")
def _(s, d):
    c = emb(s, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).withColumnRenamed("label", "id")
    return numeric.nearest_centroid(emb(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), c)


@query("rvq_roundtrip")
def _(s, d):
    few = emb(s, d).where("vec_id < 32").orderBy("vec_id").select("embedding").collect()
    books = [[list(r[0]) for r in few[:16]], [[x / 2 for x in r[0]] for r in few[16:32]]]
    return numeric.residual_codes(emb(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), books)


@query("patch_roundtrip", "SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::double * (i + 1))), 6) AS checksum FROM embeddings")
def _(s, d):
    """8 x 8 frames cut into 2 x 2 patches and put together again."""
    cut = F.expr("transform(sequence(0, 63), k -> embedding[((k div 4) div 4 * 2 + (k % 4) div 2) * 8 + (k div 4) % 4 * 2 + k % 2])")
    back = F.expr("transform(sequence(0, 63), i -> p[((i div 8) div 2 * 4 + (i % 8) div 2) * 4 + (i div 8) % 2 * 2 + i % 2])")
    e = emb(s, d).select("vec_id", cut.alias("p")).select("vec_id", back.alias("b"))
    weighted = F.transform("b", lambda x, i: x.cast("double") * (i + 1))
    return e.select("vec_id", F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


@query("vocab_classify", "SELECT i AS token, CASE WHEN i < 500 THEN 'text' WHEN i < 504 THEN 'control' WHEN i < 504 + 2 * 4 * 32 THEN 'code' ELSE 'invalid' END AS kind, CASE WHEN i >= 504 AND i < 760 THEN ((i - 504) // 32) % 4 ELSE -1 END AS level, CASE WHEN i >= 504 AND i < 760 THEN (i - 504) % 32 ELSE -1 END AS code FROM range(0, 800, 3) r(i)")
def _(s, d):
    i = F.col("id")
    code = (i >= 504) & (i < 760)
    kind = F.when(i < 500, "text").when(i < 504, "control").when(code, "code").otherwise("invalid")
    return s.range(0, 800, 3).select(i.alias("token"), kind.alias("kind"), F.when(code, F.floor((i - 504) / 32) % 4).otherwise(-1).cast("long").alias("level"), F.when(code, (i - 504) % 32).otherwise(-1).cast("long").alias("code"))


@query("quality_gate", "SELECT doc_id, CASE WHEN length(text) < 400 THEN 'low_quality' WHEN doc_id % 17 < 3 THEN 'already_learned' ELSE 'kept' END AS gate FROM documents")
def _(s, d):
    probe = F.col("doc_id") % 17
    return table(s, d, "documents").select("doc_id", F.when(F.length("text") < 400, "low_quality").when(probe < 3, "already_learned").otherwise("kept").alias("gate"))


@query("distill_totals", "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) >= 400) AS kept, CAST(sum(CASE WHEN length(text) >= 400 THEN 3 ELSE 0 END) AS BIGINT) AS epochs FROM documents GROUP BY source")
def _(s, d):
    ok = F.length("text") >= 400
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.sum(F.when(ok, 3).otherwise(0)).alias("epochs"))


@query("rehearsal_fold", "SELECT doc_id, list_filter([prev1, prev2], lambda x: x IS NOT NULL) AS rehearsed FROM (SELECT doc_id, lag(doc_id, 1) OVER w AS prev1, lag(doc_id, 2) OVER w AS prev2 FROM documents WHERE length(text) >= 400 WINDOW w AS (PARTITION BY source ORDER BY doc_id))")
def _(s, d):
    """What is rehearsed beside each kept exemplar: the two kept before it."""
    w = Window.partitionBy("source").orderBy("doc_id")
    kept = table(s, d, "documents").where(F.length("text") >= 400)
    return kept.select("doc_id", F.array_compact(F.array(F.lag("doc_id", 1).over(w), F.lag("doc_id", 2).over(w))).alias("rehearsed"))


@query("adapt_rollback_decision", f"SELECT vec_id, CASE WHEN ce > 1.25::double * 4.1::double THEN 'rollback' ELSE 'keep' END AS decision FROM (SELECT vec_id, {_CE} * (1 + vec_id % 3 * 0.3::double) AS ce FROM embeddings)")
def _(s, d):
    ce = softmax_loss(F.col("embedding"), F.col("label")) * (1 + F.col("vec_id") % 3 * 0.3)
    return emb(s, d).select("vec_id", ce.alias("ce")).select("vec_id", F.when(F.isnan("ce") | (F.col("ce") > 1.25 * 4.1), "rollback").otherwise("keep").alias("decision"))


@query("train_eval_split")
def _(s, d):
    """A tenth for evaluation, by a hash of the id: the same rows whatever the partitioning."""
    return table(s, d, "documents").select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, "eval").otherwise("train").alias("part"))


@query("dataset_quality", "SELECT lang, count(*) AS n, count(DISTINCT text) AS n_distinct, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (WHERE length(trim(text)) < 20) AS short FROM documents GROUP BY lang")
def _(s, d):
    # Two levels, so that texts are counted as hashes and the distinct ones are spread over the cluster.
    t = table(s, d, "documents").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("n"), (F.length(F.trim("text")) < 20).alias("short"))
    per = t.groupBy("lang", "h").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.count_if("short").alias("short"))
    return per.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.round(F.sum(per["n"]) / F.sum("c"), 6).alias("mean_chars"), F.sum("short").alias("short"))


@query("sentence_sequences", "SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n"))


@query("chunk_documents")
def _(s, d):
    return numeric.chunks(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("bpe_pair_counts", "WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: len(x) > 1)) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY w) SELECT substr(w, i, 1) AS left, substr(w, i + 1, 1) AS right, CAST(sum(n) AS BIGINT) AS n FROM (SELECT w, n, unnest(range(1, len(w))) AS i FROM c) GROUP BY ALL")
def _(s, d):
    w = table(s, d, "documents").select(F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 1)).alias("w"))
    return numeric.pair_counts(w.groupBy("w").agg(F.count("*").alias("n")).select(F.split("w", "").alias("symbols"), "n"))


@query("bpe_train")
def _(s, d):
    merges = numeric.train_merges(numeric.word_counts(table(s, d, "documents")), 8)
    return s.createDataFrame([(k, a, b) for k, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query("bpe_roundtrip", "SELECT doc_id, true AS same FROM documents")
def _(s, d):
    merges = [("t", "h"), ("th", "e"), (" ", "a"), ("i", "n"), ("e", "n")]
    e = table(s, d, "documents").select("doc_id", "text", numeric.encoded(F.col("text"), merges).alias("t"))
    return e.select("doc_id", (F.array_join("t", "") == F.col("text")).alias("same"))


@query("bpe_pretokens")
def _(s, d):
    return numeric.word_counts(table(s, d, "documents"))


@query("pad_truncate", "SELECT doc_id, [doc_id % 7, doc_id % 5, doc_id % 3][1:2] || [0, 0] AS ids FROM documents")
def _(s, d):
    ids = F.slice(F.array(F.col("doc_id") % 7, F.col("doc_id") % 5, F.col("doc_id") % 3), 1, 2)
    return table(s, d, "documents").select("doc_id", F.concat(ids, F.array_repeat(F.lit(0).cast("long"), 2)).alias("ids"))


@query("token_chunks", "SELECT doc_id, i // 256 AS chunk, least(256, n - i) AS length FROM (SELECT doc_id, n_chars AS n, unnest(range(0, n_chars, 256)) AS i FROM documents) WHERE n - i > 1")
def _(s, d):
    t = table(s, d, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").alias("n"), F.explode(F.expr("sequence(0L, n_chars - 1, 256L)")).alias("i"))
    return t.where("n - i > 1").select("doc_id", (F.col("i") / 256).cast("long").alias("chunk"), F.least(F.lit(256).cast("long"), F.col("n") - F.col("i")).alias("length"))


@query("crc32_check")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@query("fnv1a")
def _(s, d):
    return table(s, d, "nation").select("n_name", numeric.fnv1a(F.col("n_name")).alias("hash"))


@query("lcg_stream", "WITH RECURSIVE f AS (SELECT 0 AS i, 42::bigint AS x UNION ALL SELECT i + 1, (x * 1664525 + 1013904223) % 4294967296 FROM f WHERE i < 50) SELECT i, x FROM f")
def _(s, d):
    step = "aggregate(sequence(0, 49), array(42L), (a, i) -> concat(a, array((element_at(a, -1) * 1664525 + 1013904223) & 4294967295)))"
    return s.range(1).select(F.posexplode(F.expr(step)).alias("i", "x"))


@query("loss_scale_fold", "WITH RECURSIVE f AS (SELECT 0 AS i, 65536.0::double AS scale, 0 AS clean UNION ALL SELECT i + 1, CASE WHEN i % 37 = 0 THEN greatest(1.0::double, scale / 2) WHEN clean + 1 >= 20 THEN scale * 2 ELSE scale END, CASE WHEN i % 37 = 0 OR clean + 1 >= 20 THEN 0 ELSE clean + 1 END FROM f WHERE i < 200) SELECT i, scale FROM f WHERE i > 0")
def _(s, d):
    step = """aggregate(sequence(0, 199), array(named_struct('scale', 65536.0D, 'clean', 0)), (a, i) -> concat(a, array(named_struct(
 'scale', case when i % 37 = 0 then greatest(1.0D, element_at(a, -1).scale / 2) when element_at(a, -1).clean + 1 >= 20 then element_at(a, -1).scale * 2 else element_at(a, -1).scale end,
 'clean', case when i % 37 = 0 or element_at(a, -1).clean + 1 >= 20 then 0 else element_at(a, -1).clean + 1 end))))"""
    return s.range(1).select(F.posexplode(F.expr(step)).alias("i", "f")).where("i > 0").select("i", "f.scale")


@query("code_structure")
def _(s, d):
    return table(s, d, "pages").select("page_id", numeric.code_structure(F.col("html")).alias("score"))


@query("pass_at_1", "SELECT source, round(avg(ok::int), 9) AS pass_at_1 FROM (SELECT source, doc_id % 50 AS task, min(n_chars) > 300 AS ok FROM documents GROUP BY ALL) GROUP BY source")
def _(s, d):
    tasks = table(s, d, "documents").groupBy("source", (F.col("doc_id") % 50).alias("task")).agg((F.min("n_chars") > 300).alias("ok"))
    return tasks.groupBy("source").agg(F.round(F.avg(F.col("ok").cast("double")), 9).alias("pass_at_1"))


@query("footprint", "SELECT label, count(*) * 64 AS parameters, count(*) * 64 * 4 AS bytes_f32, count(*) * 64 AS bytes_int8 FROM embeddings GROUP BY label")
def _(s, d):
    n = F.sum(F.size("embedding")).cast("long")
    return emb(s, d).groupBy("label").agg(n.alias("parameters"), (n * 4).alias("bytes_f32"), n.alias("bytes_int8"))


_NAMES = "SELECT 'layer.' || CAST(l AS VARCHAR) || '.expert.' || CAST(e AS VARCHAR) || '.' || t AS name FROM range(6) a(l), range(4) b(e), (VALUES ('up'), ('down')) c(t)"


def tensor_names(s):
    base = s.range(6).select(F.col("id").alias("l")).crossJoin(s.range(4).select(F.col("id").alias("e")))
    return base.select(F.explode(F.array(*[F.concat(F.lit("layer."), F.col("l").cast("string"), F.lit(".expert."), F.col("e").cast("string"), F.lit(f".{t}")) for t in ("up", "down")])).alias("name"))


@query("tensor_spec", _NAMES)
def _(s, d):
    return tensor_names(s)


@query("arch_infer", f"SELECT max(regexp_extract(name, 'layer\\.(\\d+)', 1)::int) + 1 AS layers, max(regexp_extract(name, 'expert\\.(\\d+)', 1)::int) + 1 AS experts FROM ({_NAMES})")
def _(s, d):
    top = lambda p: (F.max(F.regexp_extract("name", p, 1).cast("int")) + 1)
    return tensor_names(s).agg(top(r"layer\.(\d+)").alias("layers"), top(r"expert\.(\d+)").alias("experts"))


@query("expert_extract", f"SELECT name FROM ({_NAMES}) WHERE name LIKE 'layer.2.expert.1.%'")
def _(s, d):
    return tensor_names(s).where(F.startswith("name", F.lit("layer.2.expert.1.")))


@query("layer_schedule", "SELECT i AS layer, CASE WHEN i % 4 = 3 THEN 'attention' ELSE 'recurrent' END AS kind FROM range(12) r(i)")
def _(s, d):
    return s.range(12).select(F.col("id").alias("layer"), F.when(F.col("id") % 4 == 3, "attention").otherwise("recurrent").alias("kind"))


@query("workflow_gates", "WITH m AS (SELECT label, count(*) AS n, avg(embedding[1]::double) AS loss FROM embeddings GROUP BY label) SELECT label AS step_id, CASE WHEN n < 2 THEN 'skip' WHEN loss < 0.05::double THEN 'pass' ELSE 'fail' END AS status FROM m")
def _(s, d):
    m = emb(s, d).groupBy("label").agg(F.count("*").alias("n"), F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("loss"))
    return m.select(F.col("label").alias("step_id"), F.when(F.col("n") < 2, "skip").when(F.col("loss") < 0.05, "pass").otherwise("fail").alias("status"))


@query("workflow_validate", "WITH w AS (SELECT event_id AS ord, event_type AS type, 's' || CAST(user_id % 40 AS VARCHAR) AS step_id FROM events) SELECT ord, step_id, CASE WHEN count(*) OVER (PARTITION BY step_id ORDER BY ord) > 1 THEN 'duplicate' WHEN type = 'error' THEN 'unknown' ELSE 'ok' END AS problem FROM w")
def _(s, d):
    w = table(s, d, "events").select(F.col("event_id").alias("ord"), F.col("event_type").alias("type"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("step_id"))
    earlier = F.row_number().over(Window.partitionBy("step_id").orderBy("ord"))
    return w.select("ord", "step_id", F.when(earlier > 1, "duplicate").when(F.col("type") == "error", "unknown").otherwise("ok").alias("problem"))


@query("package_validate", "SELECT p_partkey, list_filter([CASE WHEN p_size <= 0 THEN 'size' END, CASE WHEN p_size > 40 THEN 'top_k' END, CASE WHEN p_retailprice < 910 THEN 'checksum' END], lambda x: x IS NOT NULL) AS errors FROM part")
def _(s, d):
    errors = F.array(F.when(F.col("p_size") <= 0, "size"), F.when(F.col("p_size") > 40, "top_k"), F.when(F.col("p_retailprice") < 910, "checksum"))
    return table(s, d, "part").select("p_partkey", F.array_compact(errors).alias("errors"))
