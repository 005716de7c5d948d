"""Retrieval queries over documents, embeddings and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clipped, jaccard, recall_tokens, tokens
from ..operators import rank
from .catalogue import query, table

_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda x: x <> '')"
_DT = f"d AS (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents)"
_QT = f"q AS (SELECT item_id AS qid, {_TOK.format('text')} AS t FROM benchmark)"


def docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asks(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("token_stats", f"WITH {_DT} SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM d")
def _(s, d):
    t = docs(s, d).select("id", tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("token_df", f"WITH {_DT} SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY term HAVING count(DISTINCT id) >= 5")
def _(s, d):
    each = docs(s, d).select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return each.groupBy("term").agg(F.sum("c").alias("tf"), F.count("*").alias("df")).where("df >= 5")


_BM25 = f"""{_DT}, {_QT}, st AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) = 0 THEN 1.0::double ELSE avg(len(t)) END AS m FROM d),
qt AS (SELECT DISTINCT qid, unnest(t) AS term FROM q), tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / m))), 9) AS score FROM tf JOIN dfq USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id)"""


@query("bm25_topk", f"WITH {_BM25} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 10")
def bm25_topk(s, d):
    return rank.bm25(docs(s, d), asks(s, d), 10)


@query(
    "jaccard_topk",
    f"""WITH {_DT}, {_QT}, a AS (SELECT id, list_distinct(t) AS t FROM d), b AS (SELECT qid, list_distinct(t) AS t FROM q),
c AS (SELECT qid, id, nd, nq, count(*) AS c FROM (SELECT id, len(t) AS nd, unnest(t) AS w FROM a) JOIN (SELECT qid, len(t) AS nq, unnest(t) AS w FROM b) USING (w) GROUP BY ALL)
SELECT qid, id, round(c / (nd + nq - c), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(c / (nd + nq - c), 9) DESC, id) AS rank FROM c QUALIFY rank <= 5""",
)
def _(s, d):
    return rank.jaccard_top(docs(s, d), asks(s, d), 5)


_HT = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: len(x) >= 3))"


@query(
    "overlap_recall",
    f"""WITH m AS (SELECT conv_id, {_HT.format('text')} AS t FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
x AS (SELECT doc_id, {_HT.format('text')} AS t FROM documents), c AS (SELECT conv_id, doc_id, count(*) AS overlap FROM (SELECT conv_id, unnest(t) AS w FROM m) JOIN (SELECT doc_id, unnest(t) AS w FROM x) USING (w) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, doc_id) AS rank FROM c WHERE overlap >= 2 QUALIFY rank <= 3""",
)
def _(s, d):
    last = table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    words = F.array_distinct(recall_tokens(F.col("text"))).alias("t")
    hits = rank.overlap_top(table(s, d, "documents").select(F.col("doc_id").alias("id"), words), last.select(F.col("conv_id").alias("qid"), words), 3, 2)
    return hits.select(F.col("qid").alias("conv_id"), F.col("id").alias("doc_id"), "overlap", "rank")


@query(
    "set_similarity_parts",
    f"WITH x AS (SELECT doc_id, {_HT.format('text')} AS t FROM documents), y AS (SELECT item_id, {_HT.format('text')} AS t FROM benchmark WHERE item_id % 50 = 0) SELECT doc_id, item_id, len(list_intersect(x.t, y.t)) AS shared, round(CASE WHEN len(x.t) + len(y.t) = 0 THEN 1 ELSE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) END, 9) AS similarity FROM x CROSS JOIN y",
)
def _(s, d):
    """Every item whose id is divisible by 50 against all documents."""
    x = table(s, d, "documents").select("doc_id", F.array_distinct(recall_tokens(F.col("text"))).alias("a"))
    y = table(s, d, "benchmark").where("item_id % 50 = 0").select("item_id", F.array_distinct(recall_tokens(F.col("text"))).alias("b"))
    both = x.crossJoin(F.broadcast(y))
    return both.select("doc_id", "item_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(jaccard(F.col("a"), F.col("b")), 9).alias("similarity"))


_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)"


@query("dense_topk", f"SELECT e.vec_id AS id, {_COS} AS score, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id = 7) q QUALIFY rank <= 10")
def _(s, d):
    v = vectors(s, d)
    return rank.dense_top(v, v.where("id = 7").select(F.col("id").alias("qid"), "vec"), 10).select("id", "score", "rank")


@query("dense_topk_batch", f"SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY rank <= 10")
def _(s, d):
    v = vectors(s, d)
    return rank.in_blocks(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), lambda some: rank.dense_top(v, some, 10))


@query(
    "similar_with_fallback",
    f"""WITH {_DT}, {_QT}, a AS (SELECT id, list_distinct(t) AS t FROM d), b AS (SELECT qid, list_distinct(t) AS t FROM q WHERE qid % 50 = 0), n AS (SELECT count(*) AS missing FROM d LEFT JOIN embeddings ON vec_id = id WHERE embedding IS NULL),
c AS (SELECT qid, a.id, CASE WHEN missing = 0 THEN {_COS.replace('q.embedding', 'r.embedding')} ELSE round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) END AS score FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN embeddings e ON e.vec_id = a.id LEFT JOIN embeddings r ON r.vec_id = qid)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM c QUALIFY rank <= 5""",
)
def _(s, d):
    """Cosine if every candidate has a vector, else token sets; the choice is made once, from a count."""
    candidates = docs(s, d)
    v, ask = vectors(s, d), asks(s, d).where("qid % 50 = 0")
    if candidates.join(v, "id", "left_anti").isEmpty():
        return rank.dense_top(v.join(candidates.select("id"), "id", "left_semi"), ask.join(v.withColumnRenamed("id", "qid"), "qid").select("qid", "vec"), 5)
    return rank.jaccard_top(candidates, ask, 5)


_ASK = "(SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id)"
_DENSE = f"dn AS (SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e CROSS JOIN {_ASK} q)"
#: Both lists are whole: every vector, and every document with a query term, has a place.
_RRF = f"""{_BM25}, {_DENSE}, sp AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm WHERE qid IN (SELECT qid FROM dn) AND score > 0),
l AS (SELECT qid, 0 AS list_id, id, rank FROM dn UNION ALL SELECT qid, 1, id, rank FROM sp),
fu AS (SELECT qid, id, round(sum(1.0::double / (60 + rank)), 12) AS score, min(list_id * 1000000000 + rank) AS f FROM l GROUP BY qid, id),
fused AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f) AS rank FROM fu)"""


def _mmr_sql(k: int, weight: str) -> str:
    """CTEs pk1 to pk{k} from c (qid, ord, id, rel) and sim (qid, a, b, s): each adds the candidate of most relevance less redundancy."""
    steps = ["pk0 AS (SELECT qid, ord, 0 AS rank FROM c WHERE false)"]
    for n in range(1, k + 1):
        best = f"""SELECT c.qid, c.ord, round({weight} * c.rel - (1 - {weight}) * greatest(0, coalesce(max(s.s), 0)), 9) AS v FROM c LEFT JOIN pk{n - 1} p ON p.qid = c.qid LEFT JOIN sim s ON s.qid = c.qid AND s.a = c.ord AND s.b = p.ord
WHERE NOT EXISTS (SELECT 1 FROM pk{n - 1} x WHERE x.qid = c.qid AND x.ord = c.ord) GROUP BY c.qid, c.ord, c.rel"""
        steps.append(f"pk{n} AS MATERIALIZED (SELECT * FROM pk{n - 1} UNION ALL SELECT qid, ord, {n} FROM ({best}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY v DESC, ord) = 1)")
    return ", ".join(steps)


_SIM = "sim AS (SELECT x.qid, x.ord AS a, y.ord AS b, list_cosine_similarity(x.v, y.v) AS s FROM c x JOIN c y ON x.qid = y.qid AND x.ord <> y.ord)"


def _all_queries(s, d):
    return asks(s, d).join(vectors(s, d).select(F.col("id").alias("qid"), "vec"), "qid")


def _lists(s, d, depth):
    """Both lists of every query down to ``depth``, one after the other."""
    q = _all_queries(s, d)
    dense = rank.in_blocks(q, lambda some: rank.dense_top(vectors(s, d), some, depth)).select("qid", F.lit(0).alias("list_id"), F.lit(1.0).alias("weight"), "id", "rank")
    sparse = rank.in_blocks(q, lambda some: rank.bm25(docs(s, d), some, depth)).select("qid", F.lit(1).alias("list_id"), F.lit(1.0).alias("weight"), "id", "rank")
    return dense.union(sparse)


_TOP50 = _RRF.replace("e.vec_id) AS rank FROM embeddings e CROSS JOIN " + _ASK + " q)", "e.vec_id) AS rank FROM embeddings e CROSS JOIN " + _ASK + " q QUALIFY rank <= 50)").replace("AND score > 0)", "AND score > 0 QUALIFY rank <= 50)")


@query("rrf_fuse", f"WITH {_TOP50} SELECT * FROM fused")
def _(s, d):
    """The operator by itself, on the lists' first fifty."""
    return rank.rrf(_lists(s, d, 50))


@query(
    "mmr_rerank",
    f"""WITH c AS MATERIALIZED (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS ord, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY ord <= 20),
{_SIM}, {_mmr_sql(5, '0.7::double')} SELECT qid, id, pk5.rank FROM pk5 JOIN c USING (qid, ord)""",
)
def mmr_rerank(s, d):
    v = vectors(s, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    near = rank.in_blocks(q, lambda some: rank.dense_top(v, some, 20))
    return rank.mmr(near.join(v, "id").select("qid", F.col("rank").alias("ord"), "id", F.col("score").alias("rel"), "vec"), 5)


@query(
    "hybrid_retrieve",
    f"""WITH {_RRF}, w AS (SELECT qid, fused.rank AS ord, id, score, CAST(embedding AS DOUBLE[]) AS v FROM fused JOIN embeddings ON vec_id = id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fused.rank) <= 20),
c AS MATERIALIZED (SELECT w.qid, ord, id, score, v, round(list_cosine_similarity(v, CAST(q.embedding AS DOUBLE[])), 9) AS rel FROM w JOIN embeddings q ON q.vec_id = w.qid), {_SIM}, {_mmr_sql(5, '0.7::double')}
SELECT qid, id, score, pk5.rank FROM pk5 JOIN c USING (qid, ord)""",
)
def hybrid_retrieve(s, d):
    return rank.in_blocks(_all_queries(s, d), lambda some: rank.hybrid(docs(s, d), vectors(s, d), some, 5))


@query("hybrid_store_recall", f"WITH {_TOP50} SELECT qid, id, lang, score, rank FROM fused JOIN documents ON doc_id = id WHERE rank <= 10")
def _(s, d):
    """Fusion of the lists' first fifty without reranking, with the hits' rows attached again."""
    hits = rank.rrf(_lists(s, d, 50)).where("rank <= 10")
    return hits.join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id").select("qid", "id", "lang", "score", "rank")


@query(
    "recall_rendered",
    f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 5) SELECT qid, rank, CAST(id AS VARCHAR) || ' tags=[' || lang || ', ' || source || ']' || chr(10) || CASE WHEN len(text) <= 120 THEN text ELSE substr(text, 1, 120) || '…' END AS line FROM r JOIN documents ON doc_id = id",
)
def _(s, d):
    hits = rank.bm25(docs(s, d), asks(s, d), 5)
    rows = hits.join(table(s, d, "documents").withColumnRenamed("doc_id", "id"), "id")
    tags = F.concat(F.lit(" tags=["), F.array_join(F.array("lang", "source"), ", "), F.lit("]\n"))
    return rows.select("qid", "rank", F.concat(F.col("id").cast("string"), tags, clipped(F.col("text"), 120)).alias("line"))
