"""Beliefs, caches, limits, routing and prompts, on events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, flagged, sanitized
from ..operators import belief, caches, rank
from ..operators.ordering import running
from .catalogue import query, table

_CLAIMS = """claims AS (SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS subject, event_id AS ord, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS content,
 least(1.0::double, value / 100) AS importance, event_id % 3 <> 0 AS supports_new FROM events)"""
_LAG = f"{_CLAIMS}, c AS (SELECT *, lag(content) OVER (PARTITION BY subject ORDER BY ord) AS b FROM claims), v AS (SELECT subject, ord, content, CASE WHEN b IS NULL THEN 'augment' WHEN b = content THEN 'confirm' ELSE 'supersede' END AS verdict FROM c)"


def claims(s, d):
    return belief.claims_from_events(table(s, d, "events"))


@query("canonical_key", "SELECT n_nationkey, nullif(trim(regexp_replace(lower(nfc_normalize('  ' || n_name || chr(9) || ' É  x')), '\\s+', ' ', 'g')), '') AS key FROM nation")
def _(s, d):
    raw = F.concat(F.lit("  "), "n_name", F.lit("\t É  x"))
    return table(s, d, "nation").select("n_nationkey", canonical_key(raw).alias("key"))


@query("alias_resolve", "SELECT n_name AS raw, CASE WHEN n_nationkey % 5 = 0 THEN 'region ' || CAST(n_regionkey AS VARCHAR) ELSE lower(n_name) END AS subject FROM nation")
def _(s, d):
    n = table(s, d, "nation")
    alias = n.where("n_nationkey % 5 = 0").select(F.lower("n_name").alias("key"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("to"))
    keyed = n.select(F.col("n_name").alias("raw"), F.lower("n_name").alias("key"))
    return keyed.join(F.broadcast(alias), "key", "left").select("raw", F.coalesce("to", "key").alias("subject"))


@query("commit_all_supported", f"WITH {_LAG} SELECT * FROM v")
def _(s, d):
    return belief.commit_supported(claims(s, d))


@query(
    "commit_evidence",
    f"""WITH RECURSIVE {_CLAIMS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ord) AS rn FROM claims),
f AS (SELECT subject, ord, rn, 'augment' AS verdict, content AS held, importance FROM n WHERE rn = 1 UNION ALL
SELECT n.subject, n.ord, n.rn, CASE WHEN f.held = n.content THEN 'confirm' WHEN n.supports_new THEN 'supersede' ELSE 'reject' END,
 CASE WHEN f.held <> n.content AND n.supports_new THEN n.content ELSE f.held END,
 CASE WHEN f.held = n.content THEN least(1.0::double, n.importance + 0.1::double) WHEN n.supports_new THEN greatest(n.importance, 0.9::double) ELSE f.importance END
FROM f JOIN n ON n.subject = f.subject AND n.rn = f.rn + 1) SELECT subject, ord, verdict, held, round(importance, 9) AS importance FROM f""",
)
def _(s, d):
    return belief.commit(claims(s, d)).withColumn("importance", F.round("importance", 9))


@query("belief_version", f"WITH {_LAG} SELECT ord, verdict, sum(CASE WHEN verdict IN ('augment', 'supersede') THEN 1 ELSE 0 END) OVER (ORDER BY ord) AS version FROM v")
def _(s, d):
    v = belief.commit_supported(claims(s, d))
    bumps = F.when(F.col("verdict").isin("augment", "supersede"), 1).otherwise(0).cast("long")
    return running(v.select("ord", "verdict", bumps.alias("bump")), ["ord"], "bump", "version").select("ord", "verdict", "version")


@query("evidence_presence", "WITH l AS (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY user_id) SELECT user_id, list_contains(s, 'view') AND list_contains(s, 'click') AND NOT list_contains(s, 'error') AS supports FROM l")
def _(s, d):
    listing = table(s, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("l"))
    return listing.select("user_id", belief.supports(F.array(F.lit("view"), F.lit("click")), F.array(F.lit("error")), F.col("l")).alias("supports"))


@query("sanitize_flag", "SELECT conv_id, turn, regexp_matches(lower(text), 'act\\s+as') OR contains(lower(text), 'the t') AS flagged FROM conversations")
def _(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", "turn", (flagged(F.col("text")) | F.lower("text").contains("the t")).alias("flagged"))


@query("sanitize_text", "SELECT conv_id, turn, trim(replace(text, chr(1), '')) AS text FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", sanitized(F.concat("text", F.lit("\x01"))).alias("text"))


@query("recall_context", "SELECT conv_id, 'Known facts, least to most recent:' || chr(10) || string_agg('[' || CAST(turn AS VARCHAR) || '] (' || role || ') ' || text, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id")
def _(s, d):
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] ("), "role", F.lit(") "), "text")
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    block = F.concat(F.lit("Known facts, least to most recent:\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n"))
    return table(s, d, "conversations").groupBy("conv_id").agg(block.alias("block"))


@query("history_trim", "SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = table(s, d, "conversations").where("role <> 'system'")
    return said.withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("conv_id", "turn", "role")


@query("history_prompt", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || text, chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS prompt FROM conversations GROUP BY conv_id")
def _(s, d):
    who = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("")
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(who, "text").alias("line"))))
    prompt = F.concat(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\nAssistant:"))
    return table(s, d, "conversations").groupBy("conv_id").agg(prompt.alias("prompt"))


_SIGNALS = ["no, that", "not what", "instead", "wrong", "actually"]


@query("correction_signal", "SELECT conv_id, CASE WHEN contains(t, 'no, that') THEN 'no, that' WHEN contains(t, 'not what') THEN 'not what' WHEN contains(t, 'instead') THEN 'instead' WHEN contains(t, 'wrong') THEN 'wrong' WHEN contains(t, 'actually') THEN 'actually' WHEN contains(t, 'rest') THEN 'rest' ELSE '' END AS signal FROM (SELECT conv_id, lower(text) AS t FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)")
def _(s, d):
    last = table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.lower(F.max_by("text", "turn")).alias("t"))
    found = F.coalesce(*[F.when(F.col("t").contains(x), F.lit(x)) for x in [*_SIGNALS, "rest"]], F.lit(""))
    return last.select("conv_id", found.alias("signal"))


#: What marks an input as a hard one, in the order in which they are tried.
HARD = ["explain.{0,30}why", "compare|contrast", "step[ -]by[ -]step", "analy[sz]e", "prove", "design", "ther.{0,10}ther"]
_HARD_SQL = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{p}'" for p in HARD)
_ROUTE = f"r AS (SELECT conv_id, turn, length(text) AS n, CASE {_HARD_SQL} END AS pattern, (conv_id * 7 + turn * 13) % 100 AS ppl FROM conversations WHERE role = 'user')"
_DECIDE = "CASE WHEN conv_id % 10 = 0 THEN 'no_bridge' WHEN pattern IS NOT NULL THEN 'complexity' WHEN n > 1200 THEN 'length' WHEN ppl > 80 THEN 'perplexity' ELSE 'local' END"


def routed(s, d):
    c = table(s, d, "conversations").where("role = 'user'")
    pattern = F.coalesce(*[F.when(F.lower("text").rlike(p), F.lit(p)) for p in HARD])
    r = c.select("conv_id", "turn", F.length("text").alias("n"), pattern.alias("pattern"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100).alias("ppl"))
    reason = (
        F.when(F.col("conv_id") % 10 == 0, "no_bridge")
        .when(F.col("pattern").isNotNull(), "complexity")
        .when(F.col("n") > 1200, "length")
        .when(F.col("ppl") > 80, "perplexity")
        .otherwise("local")
    )
    return r.withColumn("reason", reason)


@query("route_decision", f"WITH {_ROUTE} SELECT conv_id, turn, reason, CASE WHEN reason IN ('no_bridge', 'local') THEN 'local' ELSE 'remote' END AS target, CASE reason WHEN 'no_bridge' THEN 1.0 WHEN 'complexity' THEN 0.9 WHEN 'length' THEN 0.85 WHEN 'perplexity' THEN least(0.95::double, 0.5::double + (ppl - 80) / 200.0::double) ELSE 0.8 END::double AS confidence FROM (SELECT *, {_DECIDE} AS reason FROM r)")
def _(s, d):
    by = F.col("reason")
    confidence = F.when(by == "no_bridge", 1.0).when(by == "complexity", 0.9).when(by == "length", 0.85).when(by == "perplexity", F.least(F.lit(0.95), 0.5 + (F.col("ppl") - 80) / 200.0)).otherwise(0.8)
    return routed(s, d).select("conv_id", "turn", "reason", F.when(by.isin("no_bridge", "local"), "local").otherwise("remote").alias("target"), confidence.alias("confidence"))


@query("route_audit", f"WITH {_ROUTE} SELECT reason, count(*) AS n, round(avg(n), 6) AS mean_length FROM (SELECT *, {_DECIDE} AS reason FROM r) GROUP BY reason")
def _(s, d):
    return routed(s, d).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("n"), 6).alias("mean_length"))


def requests(s, d, key=None):
    key = F.col("text") if key is None else key
    c = table(s, d, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") % 4).cast("string").alias("cache"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), key.alias("key"))


_REQ = "r AS (SELECT CAST(conv_id % 4 AS VARCHAR) AS cache, conv_id * 100 + turn AS ord, text AS key FROM conversations WHERE role = 'user')"


@query("exact_cache_hits", f"WITH {_REQ} SELECT cache, ord, key, row_number() OVER (PARTITION BY cache, key ORDER BY ord) > 1 AS hit FROM r")
def _(s, d):
    return caches.exact_hits(requests(s, d))


@query("cache_stats", f"WITH {_REQ}, h AS (SELECT cache, row_number() OVER (PARTITION BY cache, key ORDER BY ord) > 1 AS hit FROM r) SELECT cache, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM h GROUP BY cache")
def _(s, d):
    return caches.exact_hits(requests(s, d)).groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query("lru_cache_sim")
def _(s, d):
    return caches.lru(requests(s, d, F.sha2("text", 256)), 8)


@query("semantic_cache_sim")
def _(s, d):
    e = table(s, d, "embeddings")
    return caches.semantic(e.select(F.col("label").cast("string").alias("cache"), F.col("vec_id").alias("ord"), (F.col("vec_id") * 1000).alias("ts_ms"), F.col("embedding").alias("vec")), 0.3, 16, 300_000)


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"


@query("semantic_lookup", f"SELECT a.vec_id AS ask, max({_COS}) AS score, max({_COS}) >= 0.35 AS hit FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 10 = 0 WHERE a.vec_id % 10 <> 0 GROUP BY a.vec_id")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.col("embedding").alias("vec"))
    best = rank.nearest_held(e.where("id % 10 <> 0"), e.where("id % 10 = 0"))
    return best.select(F.col("id").alias("ask"), "score", (F.col("score") >= 0.35).alias("hit"))


@query("cache_key", "SELECT conv_id, turn, '[\"' || role || '\",\"' || CAST(turn AS VARCHAR) || '\"]' AS cache_key FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.to_json(F.array("role", F.col("turn").cast("string"))).alias("cache_key"))


@query("semantic_key", "SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS semantic_key FROM conversations GROUP BY conv_id")
def _(s, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("k"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["k"]), "\n").alias("semantic_key"))


@query("version_cache_hits", "WITH r AS (SELECT event_id, event_id // 500 AS version, event_type || ':' || CAST(user_id % 20 AS VARCHAR) AS q FROM events) SELECT version, count(*) AS asked, count(*) FILTER (WHERE rn > 1) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY version, q ORDER BY event_id) AS rn FROM r) GROUP BY version")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.floor(F.col("event_id") / 500).cast("long").alias("version"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("q"))
    # The first of each (version, question) misses, the rest hit: counts suffice.
    per = e.groupBy("version", "q").agg(F.count("*").alias("n"))
    return per.groupBy("version").agg(F.sum("n").alias("asked"), F.sum(F.col("n") - 1).alias("hits"))


@query(
    "rate_limit",
    """WITH RECURSIVE h AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS caller, event_id AS ord, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT caller, ord, rn, ts_ms + 86400000 AS reset, 1 AS c FROM h WHERE rn = 1 UNION ALL
SELECT h.caller, h.ord, h.rn, CASE WHEN h.ts_ms >= f.reset THEN h.ts_ms + 86400000 ELSE f.reset END, CASE WHEN h.ts_ms >= f.reset THEN 1 ELSE f.c + 1 END FROM f JOIN h ON h.caller = f.caller AND h.rn = f.rn + 1)
SELECT caller, ord, c <= 2 AS allowed FROM f""",
)
def _(s, d):
    hits = table(s, d, "events").select(F.col("user_id").cast("string").alias("caller"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return caches.rate_limit(hits, 86_400_000, 2)


@query("embed_delta", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id >= 400")
def _(s, d):
    """Vectors to compute: new keys, and keys whose sequence number moved on."""
    now = table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, 2).otherwise(1).alias("seq"))
    had = table(s, d, "embeddings").where("vec_id < 400").select("vec_id", F.lit(1).alias("seq"))
    return now.join(had, ["vec_id", "seq"], "left_anti").select("vec_id")


@query("ledger_union", "WITH a AS (SELECT conv_id, 'd' || CAST((conv_id * 3 + turn) % 50 AS VARCHAR) AS key FROM conversations) SELECT conv_id, count(DISTINCT key) AS surfaced FROM a GROUP BY conv_id")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", F.concat(F.lit("d"), ((F.col("conv_id") * 3 + F.col("turn")) % 50).cast("string")).alias("key"))
    return c.distinct().groupBy("conv_id").agg(F.count("*").alias("surfaced"))


@query("agent_turn_count", "SELECT conv_id, count(*) FILTER (WHERE role <> 'system') // 2 AS turns FROM conversations GROUP BY conv_id")
def _(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.floor(F.count_if(F.col("role") != "system") / 2).cast("long").alias("turns"))


@query("response_trim", "SELECT conv_id, turn, trim(split_part(text || chr(10) || 'User: next', chr(10) || 'User:', 1)) AS reply FROM conversations WHERE role = 'assistant'")
def _(s, d):
    said = F.concat("text", F.lit("\nUser: next"))
    return table(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.trim(F.split_part(said, F.lit("\nUser:"), F.lit(1))).alias("reply"))


@query("fence_strip", "SELECT conv_id, turn, text AS code FROM conversations WHERE turn = 1")
def _(s, d):
    fenced = F.concat(F.lit("```py\n"), "text", F.lit("\n```"))
    return table(s, d, "conversations").where("turn = 1").select("conv_id", "turn", F.regexp_extract(fenced, r"(?s)```[a-z]*\n(.*)\n```", 1).alias("code"))


@query("best_candidate", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) > 200 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) = 1")
def _(s, d):
    ok = table(s, d, "conversations").where("role = 'assistant'").where(F.length("text") > 200)
    return ok.groupBy("conv_id").agg(F.max_by("turn", F.struct(F.length("text"), -F.col("turn"))).alias("turn"))


@query("sse_parse", "SELECT conv_id, turn, text AS delta FROM conversations")
def _(s, d):
    c = table(s, d, "conversations")
    stream = F.concat(F.lit(": ping\ndata: "), F.to_json(F.struct(F.col("text").alias("delta"))), F.lit("\n\ndata: {bad\n\ndata: [DONE]\n"))
    lines = c.select("conv_id", "turn", F.explode(F.split(stream, "\n")).alias("line")).where(F.startswith("line", F.lit("data:")))
    return lines.select("conv_id", "turn", F.get_json_object(F.trim(F.substring("line", 6, 1 << 30)), "$.delta").alias("delta")).where("delta is not null")


@query("auth_hash", "SELECT c_custkey, sha256(c_name) AS token_hash FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("token_hash"))


@query("bearer_parse", "SELECT c_custkey, c_name AS token FROM customer")
def _(s, d):
    header = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Bearer ").otherwise("bearer   "), "c_name")
    return table(s, d, "customer").select("c_custkey", F.regexp_extract(header, r"(?i)^Bearer\s+(.+)$", 1).alias("token"))
