"""Queries over the fact store, on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import store
from ..operators.ordering import running
from ..sources.tables import shared_path
from .catalogue import query, table

NOW = store.NOW
_TTL = "CASE event_type WHEN 'view' THEN 604800000 WHEN 'click' THEN 1209600000 WHEN 'error' THEN 259200000 WHEN 'signup' THEN 2592000000 END"
FACTS = f"""facts AS (SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS key, props AS content, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq,
 {_TTL} AS ttl_ms, event_type, ['' || event_type, 'u' || CAST(user_id % 10 AS VARCHAR)] AS tags, least(1.0::double, value / 100) AS importance FROM events)"""
LATEST = "latest AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) = 1)"
LIVE = f"live AS (SELECT * FROM latest WHERE ttl_ms IS NULL OR {NOW} <= ts_ms + ttl_ms)"
WITH = f"WITH {FACTS}, {LATEST}, {LIVE}"


def facts(spark, d) -> DataFrame:
    return store.facts_from_events(table(spark, d, "events"))


@query("fact_latest", f"{WITH} SELECT key, content, ts_ms, seq, importance FROM latest")
def _(s, d):
    return store.latest(facts(s, d)).select("key", "content", "ts_ms", "seq", "importance")


@query("fact_live_scan", f"{WITH} SELECT key, content, ts_ms, row_number() OVER (ORDER BY ts_ms DESC, seq DESC) AS rn FROM live")
def _(s, d):
    live = store.live(facts(s, d)).select("key", "content", "ts_ms", "seq", F.lit(1).cast("long").alias("one"))
    return running(live, ["-ts_ms", "-seq"], "one", "rn").select("key", "content", "ts_ms", "rn")


@query("fact_point_lookup", f"{WITH} SELECT key, content, ts_ms FROM live WHERE key IN ('view:7', 'purchase:46', 'error:8', 'none:1')")
def _(s, d):
    # The key filter goes below the aggregation, to the scan.
    wanted = facts(s, d).where(F.col("key").isin("view:7", "purchase:46", "error:8", "none:1"))
    return store.live(wanted).select("key", "content", "ts_ms")


@query("fact_recent_n", f"{WITH} SELECT key, ts_ms, row_number() OVER (ORDER BY ts_ms DESC, seq DESC, key) AS rn FROM live QUALIFY rn <= 25")
def _(s, d):
    return store.newest(store.live(facts(s, d)), 25).select("key", "ts_ms", "rn")


@query("fact_by_tag", f"{WITH} SELECT key, content FROM live WHERE list_contains(tags, 'u3')")
def _(s, d):
    return store.with_tag(store.live(facts(s, d)), "u3").select("key", "content")


@query("fact_purge_count", f"{WITH} SELECT count(*) AS purged FROM latest WHERE ttl_ms IS NOT NULL AND {NOW} > ts_ms + ttl_ms")
def _(s, d):
    return store.latest(facts(s, d)).where(~store.is_live()).agg(F.count("*").alias("purged"))


@query(
    "fact_cap_evict",
    f"{WITH} SELECT key, importance FROM (SELECT *, coalesce(ttl_ms IS NULL OR {NOW} <= ts_ms + ttl_ms, true) AS alive FROM latest) ORDER BY alive DESC, importance DESC, ts_ms DESC, seq DESC, key LIMIT 200",
)
def _(s, d):
    return store.keep_most_important(store.latest(facts(s, d)), 200).select("key", "importance")


_SPLIT = f"""WITH {FACTS}, a AS (SELECT * FROM facts WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) = 1),
b AS (SELECT * FROM facts WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) = 1)"""


def halves(s, d):
    log = facts(s, d)
    return store.latest(log.where("seq % 2 = 0")), store.latest(log.where("seq % 2 = 1"))


@query(
    "fact_import_merge",
    f"""{_SPLIT} SELECT coalesce(a.key, b.key) AS key, CASE WHEN w THEN b.content ELSE a.content END AS content, CASE WHEN w THEN b.ts_ms ELSE a.ts_ms END AS ts_ms
FROM (SELECT a.key AS ak, b.key AS bk, coalesce(b.key IS NOT NULL AND (a.key IS NULL OR (a.ttl_ms IS NOT NULL AND {NOW} > a.ts_ms + a.ttl_ms) OR b.ts_ms > a.ts_ms), false) AS w FROM a FULL JOIN b ON a.key = b.key) j
LEFT JOIN a ON a.key = ak LEFT JOIN b ON b.key = bk""",
)
def _(s, d):
    return store.merge_import(*halves(s, d)).select("key", "content", "ts_ms")


@query("fact_import_overwrite", f"{_SPLIT} SELECT coalesce(b.key, a.key) AS key, coalesce(b.content, a.content) AS content, coalesce(b.ts_ms, a.ts_ms) AS ts_ms FROM a FULL JOIN b ON a.key = b.key")
def _(s, d):
    return store.merge_import(*halves(s, d), overwrite=True).select("key", "content", "ts_ms")


@query(
    "import_merge_outer",
    f"{_SPLIT} SELECT CASE WHEN b.key IS NULL THEN 'kept' WHEN a.key IS NULL THEN 'added' WHEN b.ts_ms > a.ts_ms THEN 'newer' ELSE 'older' END AS outcome, count(*) AS n FROM a FULL JOIN b ON a.key = b.key GROUP BY 1",
)
def _(s, d):
    a, b = halves(s, d)
    both = a.select("key", F.col("ts_ms").alias("at")).join(b.select("key", F.col("ts_ms").alias("bt")), "key", "full_outer")
    outcome = F.when(F.col("bt").isNull(), "kept").when(F.col("at").isNull(), "added").when(F.col("bt") > F.col("at"), "newer").otherwise("older")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("fact_snapshot_roundtrip", f"{WITH} SELECT key, content, tags[1] AS tag, importance FROM live")
def _(s, d):
    path = shared_path(s, "snapshot")
    store.write_snapshot(store.live(facts(s, d)), path)
    return store.read_snapshot(s, path).select("key", "content", F.get("tags", F.lit(0)).alias("tag"), "importance")


@query("fact_export", f"{WITH} SELECT key, content, ts_ms, seq, coalesce(ttl_ms, -1) AS ttl_ms, 'json' AS fact_type, importance FROM live")
def _(s, d):
    return store.live(facts(s, d)).select("key", "content", "ts_ms", "seq", F.coalesce("ttl_ms", F.lit(-1)).alias("ttl_ms"), "fact_type", "importance")


@query("fact_forget", f"{WITH} SELECT key, content FROM latest WHERE key NOT IN (SELECT 'view:' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey < 50)")
def _(s, d):
    gone = table(s, d, "customer").where("c_custkey < 50").select(F.concat(F.lit("view:"), F.col("c_custkey").cast("string")).alias("key"))
    return store.latest(store.forget(facts(s, d), gone)).select("key", "content")


@query("fact_importance_order", f"{WITH} SELECT key, round(importance, 9) AS importance, row_number() OVER (ORDER BY importance DESC, ts_ms DESC, seq DESC) AS rn FROM live QUALIFY rn <= 50")
def _(s, d):
    top = store.live(facts(s, d)).orderBy(F.desc("importance"), F.desc("ts_ms"), F.desc("seq")).limit(50)
    rn = F.row_number().over(Window.orderBy(F.desc("importance"), F.desc("ts_ms"), F.desc("seq")))
    return top.select("key", F.round("importance", 9).alias("importance"), rn.alias("rn"))


@query("fact_substring_select", "SELECT conv_id, turn, n_name AS key FROM conversations JOIN nation ON contains(upper(text), substr(n_name, 1, 3))")
def _(s, d):
    # A condition that isn't an equality: the side of keys is the small nation table, sent to each task.
    keys = F.broadcast(table(s, d, "nation").select(F.col("n_name").alias("key")))
    return table(s, d, "conversations").join(keys, F.upper("text").contains(F.substring("key", 1, 3))).select("conv_id", "turn", "key")


@query("hidden_key_filter", f"{WITH} SELECT event_type, count(*) AS n FROM live WHERE key <> 'view:7' GROUP BY event_type")
def _(s, d):
    shown = store.live(facts(s, d)).where("key <> 'view:7'")
    return shown.groupBy(F.get("tags", F.lit(0)).alias("event_type")).agg(F.count("*").alias("n"))


@query(
    "fact_select_modes",
    f"""{WITH}, m AS (SELECT 'all' AS mode, key FROM live UNION ALL SELECT 'tagged', key FROM live WHERE list_contains(tags, 'purchase')
UNION ALL SELECT 'substring', key FROM live WHERE contains('what of view:7 and error:8 then', key)) SELECT mode, count(*) AS n, min(key) AS first FROM m GROUP BY mode""",
)
def _(s, d):
    live = store.live(facts(s, d))
    asked = F.lit("what of view:7 and error:8 then")
    modes = F.array(F.lit("all"), F.when(F.array_contains("tags", "purchase"), "tagged"), F.when(asked.contains(F.col("key")), "substring"))
    return live.select("key", F.explode(F.array_compact(modes)).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"), F.min("key").alias("first"))


_TRUST = f"greatest(0.0::double, least(1.0::double, importance)) * (0.5::double + 0.5::double * pow(2.0::double, -(greatest(0, {NOW} - ts_ms) / 2592000000.0::double)))"


@query("trust_score", f"{WITH} SELECT key, round({_TRUST}, 9) AS trust FROM live")
def _(s, d):
    return store.live(facts(s, d)).select("key", F.round(store.trust(F.col("importance"), F.col("ts_ms")), 9).alias("trust"))


@query("trust_rerank", f"{WITH}, t AS (SELECT key, event_type AS tag, ts_ms, seq, round({_TRUST}, 9) AS trust FROM live) SELECT tag, key, trust, row_number() OVER (PARTITION BY tag ORDER BY trust DESC, ts_ms DESC, seq DESC) AS rank FROM t QUALIFY rank <= 5")
def _(s, d):
    t = store.live(facts(s, d)).select("key", F.get("tags", F.lit(0)).alias("tag"), "ts_ms", "seq", F.round(store.trust(F.col("importance"), F.col("ts_ms")), 9).alias("trust"))
    w = Window.partitionBy("tag").orderBy(F.desc("trust"), F.desc("ts_ms"), F.desc("seq"))
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("tag", "key", "trust", "rank")


@query("ttl_sweep", f"{WITH} SELECT event_type, count(*) FILTER (WHERE ttl_ms IS NOT NULL AND {NOW} > ts_ms + ttl_ms) AS expired, count(*) AS held FROM latest GROUP BY event_type")
def _(s, d):
    all_ = store.latest(facts(s, d))
    return all_.groupBy(F.get("tags", F.lit(0)).alias("event_type")).agg(F.count_if(~store.is_live()).alias("expired"), F.count("*").alias("held"))


@query("tenant_isolation", f"{WITH} SELECT event_type AS tenant, count(*) AS n, count(DISTINCT key) AS keys FROM facts WHERE event_type = 'purchase' GROUP BY 1")
def _(s, d):
    own = facts(s, d).where(F.get("tags", F.lit(0)) == "purchase")
    return own.groupBy(F.get("tags", F.lit(0)).alias("tenant")).agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("model_ranking_top3", "WITH g AS (SELECT event_type, user_id, count(*) AS calls, round(sum(value), 6) AS cost FROM events GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY calls DESC, cost DESC, user_id) AS rank FROM g QUALIFY rank <= 3")
def _(s, d):
    g = table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 6).alias("cost"))
    w = Window.partitionBy("event_type").orderBy(F.desc("calls"), F.desc("cost"), "user_id")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
