"""Ranked retrieval for batches of queries: BM25, Jaccard, cosine, rank fusion and diversity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from ..sources.tables import written

DIGITS = 9


def top(scored: DataFrame, query: str, k: int, *order) -> DataFrame:
    """The k best of each query with ``rank`` from 1; Spark limits each partition before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


#: Numbers in a matrix that a task makes at once (16 MB); what would be larger goes in slices of rows.
TILE = 1 << 21


def slices(batch: pa.RecordBatch, width: int):
    """The batch in slices of as many rows as TILE holds, of ``width`` numbers each."""
    n = max(1, TILE // max(1, width))
    return (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def matrix(vecs: pa.ListArray) -> np.ndarray:
    return vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """q x rows, not rounded; 0 where a norm is 0 or anything isn't finite."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        s = q @ x.T
        s /= np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return s if np.isfinite(s.sum()) else np.nan_to_num(s, copy=False, nan=0.0, posinf=0.0, neginf=0.0)


class Best:
    """The k best (rounded score, id) of each of n queries over batches: memory for k a query and one tile, whatever the number of rows."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        self.new, self.waiting, self.patience = [], 0, max(2 * k * len(qids), 1 << 17)
        #: The k-th score of each query so far, or less.
        self.low = np.full(len(qids), np.finfo(np.float64).min)

    def add(self, score: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """score: queries x rows, -inf where a row is no hit; ``of`` has the queries' places, if these aren't all."""
        of, gap = np.arange(len(self.qids)) if of is None else of, 10.0**-DIGITS
        # What ties with the k-th score after rounding stays, since its id may be smaller.
        near = score >= (self.low[of] - gap)[:, None]
        many = np.count_nonzero(near, axis=1) > 4 * self.k
        if many.any():
            cut = np.partition(score[many], score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k].round(DIGITS)
            self.low[of[many]] = np.maximum(self.low[of[many]], cut)
            near[many] = score[many] >= (self.low[of[many]] - gap)[:, None]
        row, col = np.nonzero(near)
        self.put(of[row], score[row, col].round(DIGITS), ids[col])

    def put(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Single hits: the places of their queries, rounded scores, ids."""
        self.new.append((q, score, ids))
        self.waiting += len(q)
        if self.waiting > self.patience:
            self.settle()

    def settle(self) -> None:
        q, s, i = (np.concatenate(c) for c in zip(self.held, *self.new, strict=True))
        at = np.lexsort((i, -s, q))
        q, s, i = q[at], s[at], i[at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.low[q[last]] = np.maximum(self.low[q[last]], s[last])
        self.held, self.new, self.waiting = [c[place < self.k] for c in (q, s, i)], [], 0

    def batch(self) -> pa.RecordBatch:
        self.settle()
        q, s, i = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.qids[q]), pa.array(i), pa.array(s)], ["qid", "id", "score"])


class Scorer:
    """A stated set of queries (qids) against all rows: ``score`` makes some of ``rows`` (id first) a matrix, queries x rows.

    It gets slices of at most TILE numbers, with ``width`` numbers a row where it makes more than one a query.
    """

    def __init__(self, rows: DataFrame, qids: np.ndarray, model, score: Callable, width: int = 1):
        self.rows, self.score, self.width = rows.withColumn("id", F.col("id").cast("long")), score, max(width, len(qids))
        self.sent = rows.sparkSession.sparkContext.broadcast((qids, model))

    def best(self, k: int) -> DataFrame:
        """qid, id, score, rank of the k best, ties to the smaller id; a task gives k a query."""
        sent, score, width = self.sent, self.score, self.width

        def run(batches):
            qids, model = sent.value
            held = Best(qids, k)
            for batch in batches:
                for part in slices(batch, width) if len(qids) else ():
                    held.add(score(model, part), part.column(0).to_numpy(zero_copy_only=False))
            yield held.batch()

        return top(self.rows.mapInArrow(run, "qid long, id long, score double"), "qid", k, F.desc("score"), "id")

    def places(self, named: DataFrame, most: int = 1_000_000) -> DataFrame:
        """qid, id, rank that the pairs in ``named`` have among all rows; those that are no hit are left out.

        ``named`` holds a bounded number of rows a query. It is sent to the executors, which count the better rows.
        """
        pairs = named.select("qid", "id").limit(most + 1).collect()
        if len(pairs) > most:
            raise ValueError(f"more than {most} rows to be placed; send the queries in blocks")
        sent, score, width = self.sent, self.score, self.width
        wanted: dict[int, list[int]] = {}
        for q, i in pairs:
            wanted.setdefault(q, []).append(i)

        def own(batches):
            qids, model = sent.value
            for batch in (part for whole in batches for part in slices(whole, width)):
                ids, s = batch.column(0).to_numpy(zero_copy_only=False), score(model, batch).round(DIGITS)
                rows = [(int(q), int(ids[c]), float(s[j, c])) for j, q in enumerate(qids) for c in np.flatnonzero(np.isin(ids, wanted.get(int(q), []))) if s[j, c] > -np.inf]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "id", "score"])

        few = self.rows.join(F.broadcast(named.select("id").distinct()), "id", "left_semi").select(*self.rows.columns)
        found = few.mapInArrow(own, "qid long, id long, score double").collect()
        held = {q: np.sort(np.array([(-r[2], r[1]) for r in found if r[0] == q], [("s", "f8"), ("id", "i8")])) for q in {r[0] for r in found}}

        def count(batches):
            qids, model = sent.value
            better = {q: np.zeros(len(h) + 1, np.int64) for q, h in held.items()}
            for batch in (part for whole in batches for part in slices(whole, width)):
                ids, s = batch.column(0).to_numpy(zero_copy_only=False), score(model, batch).round(DIGITS)
                for j, q in enumerate(qids.tolist()):
                    if q in held:
                        hit = s[j] > -np.inf
                        one = np.empty(int(hit.sum()), held[q].dtype)
                        one["s"], one["id"] = -s[j][hit], ids[hit]
                        # The first of those held that a row is better than, and so than all after it.
                        better[q] += np.bincount(np.searchsorted(held[q], one, side="right"), minlength=len(held[q]) + 1)
            rows = [(q, int(i), int(n)) for q, b in better.items() for i, n in zip(held[q]["id"], np.cumsum(b)[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [[]] * 3], ["qid", "id", "n"])

        counted = self.rows.mapInArrow(count, "qid long, id long, n long")
        return counted.groupBy("qid", "id").agg((F.sum("n") + 1).cast("int").alias("rank"))


class Asked:
    """A bounded set of queries as term lists: their ids, the terms that occur, and which query has which (terms x queries)."""

    def __init__(self, queries: DataFrame, most: int = 5000):
        """queries (qid, t: array of different terms)."""
        rows = queries.select(F.col("qid").cast("long"), "t").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} queries; send them in blocks")
        self.qids = np.array([r[0] for r in rows], np.int64)
        self.terms = sorted({w for r in rows for w in r[1]})
        place = {w: k for k, w in enumerate(self.terms)}
        self.has = np.zeros((len(self.terms), len(rows)))
        for j, r in enumerate(rows):
            self.has[[place[w] for w in r[1]], j] = 1
        self.sizes = np.array([len(r[1]) for r in rows], np.int64)

    def known(self, lists: pa.ListArray) -> pa.ListArray:
        """The numbers of the terms among the strings of each list, repeats included."""
        at = pc.index_in(lists.flatten(), value_set=pa.array(self.terms, pa.string()))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        n = np.bincount(row[pc.is_valid(at).to_numpy(zero_copy_only=False)], minlength=len(lists))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), at.drop_null())

    def counts(self, lists: pa.ListArray) -> np.ndarray:
        """rows x terms: how often each term's number is in each list."""
        n, m = len(lists), len(self.terms)
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        return np.bincount(row * m + lists.flatten().to_numpy(), minlength=n * m).reshape(n, m).astype(float)


def bm25_scorer(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> Scorer:
    """Texts are read once: what is scored, and counted for the terms' weights, is a written table of the queries' terms in them."""
    asked = Asked(queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("t")))
    sent = docs.sparkSession.sparkContext.broadcast(asked)

    def narrow(batches):
        for batch in (part for whole in batches for part in slices(whole, 4096)):
            yield pa.RecordBatch.from_arrays([batch.column(0), sent.value.known(batch.column(1)), batch.column(2)], ["id", "t", "dl"])

    sized = docs.select(F.col("id").cast("long").alias("id"), tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    sized = written(sized.mapInArrow(narrow, "id long, t array<int>, dl int"), "query-terms")
    total = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    df = {r[0]: r[1] for r in sized.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").count().collect()}
    n, mean = total["n"], total["mean"] or 1.0
    idf = np.array([np.log(1 + (n - df.get(k, 0) + 0.5) / (df.get(k, 0) + 0.5)) for k in range(len(asked.terms))])

    def score(model, batch):
        asked, idf = model
        tf = asked.counts(batch.column(1))
        dl = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
        s = ((idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))) @ asked.has).round(DIGITS).T
        return np.where(s > 0, s, -np.inf)

    return Scorer(sized, asked.qids, (asked, idf), score, len(asked.terms))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, id, score, rank from docs (id, text) and queries (qid, text); documents without a query term aren't hits.

    Rows of one id are documents of their own. The queries are a stated set that is sent to the executors; no pair of
    a document and a query leaves the task that scored it unless it may be a hit.
    """
    return bm25_scorer(docs, queries, k1, b).best(k)


def jaccard_top(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, score, rank by token-set similarity; only pairs that share a token. Scored as bm25 does, in one pass."""
    asked = Asked(queries.select("qid", F.array_distinct(tokens(F.col("text"))).alias("t")))

    def score(asked, batch):
        shared = (np.minimum(asked.counts(asked.known(batch.column(1))), 1) @ asked.has).T
        n = np.diff(batch.column(1).offsets.to_numpy())
        return np.where(shared > 0, (shared / np.maximum(1, n + asked.sizes[:, None] - shared)).round(DIGITS), -np.inf)

    return Scorer(docs.select("id", F.array_distinct(tokens(F.col("text"))).alias("t")), asked.qids, asked, score, len(asked.terms)).best(k)


def dense_scorer(vectors: DataFrame, queries: DataFrame, most_queries: int = 5000) -> Scorer:
    rows = [(r[0], r[1]) for r in queries.select("qid", F.col("vec").cast("array<double>")).limit(most_queries + 1).collect()]
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries; send them in parts")
    rows = [r for r in rows if r[1]]

    vecs = vectors.where("vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))
    return Scorer(vecs, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), lambda q, batch: cosines(q, matrix(batch.column(1))))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 5000) -> DataFrame:
    """qid, id, score, rank by cosine from vectors (id, vec) and queries (qid, vec), a stated set of at most ``most_queries``.

    The queries are sent to the executors; each slice of vectors is one matrix product, and a task keeps its k best.
    """
    return dense_scorer(vectors, queries, most_queries).best(k)


def in_blocks(queries: DataFrame, search, block: int = 2500) -> DataFrame:
    """The union of ``search`` over blocks of about ``block`` queries, by the hash of qid: all of them are asked."""
    parts = -(-queries.count() // block)
    if parts < 2:
        return search(queries)
    queries.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    of = F.pmod(F.xxhash64("qid"), F.lit(parts))
    return reduce(DataFrame.union, [search(queries.where(of == k)) for k in range(parts)])


def ann_top(vectors: DataFrame, queries: DataFrame, k: int = 10, exact_up_to: int = 256, lists: int = 64, probes: float = 0.75) -> DataFrame:
    """dense_top, exactly up to so many vectors, else over the ``probes`` nearest part of inverted lists.

    The lists' centres are the ``lists`` vectors with the least hashes. Each vector is filed under the centre
    with the highest cosine and meets the queries that probe its list; blocks of queries are sent to the executors,
    the vectors of a batch that share a list are one matrix product, and a task keeps its k best of each query.
    """
    seeds = vectors.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    if seeds.limit(exact_up_to + 1).count() <= exact_up_to:
        return in_blocks(queries, lambda some: dense_top(vectors, some, k))
    centres = np.array([r[0] for r in seeds.orderBy(F.xxhash64("id"), "id").select("vec").limit(lists).collect()])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    probed = int(np.ceil(probes * len(centres)))

    def search(some: DataFrame) -> DataFrame:
        rows = [r for r in some.select("qid", F.col("vec").cast("array<double>")).collect() if r[1]]
        q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), centres.shape[1])
        asks = np.zeros((len(centres), len(rows)), bool)
        np.put_along_axis(asks, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probed].T, True, axis=0)
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), q, asks))

        def run(batches):
            qids, q, asks = sent.value
            held = Best(qids, k)
            for batch in batches if len(qids) else ():
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                own = np.argmax(x @ centres.T, axis=1) if len(x) else np.zeros(0, int)
                for one in np.unique(own):
                    of, at = np.flatnonzero(asks[one]), np.flatnonzero(own == one)
                    for part in np.array_split(at, -(-len(at) * len(of) // TILE)) if len(of) else ():
                        held.add(cosines(q[of], x[part]), ids[part], of)
            yield held.batch()

        return top(seeds.mapInArrow(run, "qid long, id long, score double"), "qid", k, F.desc("score"), "id")

    return in_blocks(queries, search)


def nearest_held(asked: DataFrame, held: DataFrame, block: int = 20_000) -> DataFrame:
    """id, score: the highest cosine of each of ``asked`` (id, key, vec) with those of ``held`` (id, key, vec) of the same key, if there is one.

    Blocks of ``held`` by the hash of its ids are sent to the executors one by one; the asked rows of a batch that share
    a key are one matrix product in slices, and give a number each, so no pair is shuffled. Vectors of two lengths are
    compared over the shorter; components that are null count as 0.
    """
    spark, held = asked.sparkSession, held.where("key is not null")
    parts = max(1, -(-held.count() // block))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def cosine_most(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            n = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(h, axis=1))
            s = np.divide(x @ h.T, n, out=np.zeros(n.shape), where=n != 0)
        return s.max(axis=1).round(DIGITS)

    def by_length(v: pa.ListArray):
        """(places, matrix) of the vectors of each length."""
        size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        for n in np.unique(size[size >= 0]):
            at = np.flatnonzero(size == n)
            yield at, pc.fill_null(v.take(pa.array(at)).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(len(at), n)

    def search(k: int) -> DataFrame:
        t = held.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("key", F.col("vec").cast("array<double>")).toArrow().combine_chunks()
        keys, vecs = (pa.concat_arrays(t.column(c).chunks or [pa.array([], t.schema.field(c).type)]) for c in (0, 1))
        made = {key.as_py(): [h for _, h in by_length(vecs.filter(pc.equal(keys, key)))] for key in keys.unique()}
        sent = spark.sparkContext.broadcast(made)

        def run(batches):
            for batch in batches:
                for key in batch.column(1).unique():
                    kinds = sent.value.get(key.as_py())
                    if kinds is None:
                        continue
                    own = batch.filter(pc.equal(batch.column(1), key))
                    most = np.full(own.num_rows, -np.inf)
                    for at, x in by_length(own.column(2)):
                        for h in kinds:
                            w = min(h.shape[1], x.shape[1])
                            for part in np.array_split(np.arange(len(at)), -(-len(at) * len(h) // TILE)):
                                most[at[part]] = np.maximum(most[at[part]], cosine_most(h[:, :w], x[part, :w]))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(most, pa.float64(), mask=most == -np.inf)], ["id", "score"])

        return asked.where("key is not null").select(F.col("id").cast("long"), "key", F.col("vec").cast("array<double>")).mapInArrow(run, "id long, score double")

    return reduce(DataFrame.union, [search(k) for k in range(parts)]).groupBy("id").agg(F.max("score").alias("score"))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the ranges with these starts and lengths, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def overlap_top(docs: DataFrame, queries: DataFrame, k: int = 3, least: int = 2, block: int = 50_000, first: int = 8192) -> DataFrame:
    """qid, id, overlap, rank of the k documents (id, t) with most terms of each query (qid, t), ``least`` at least, ties to the smaller id; t: different terms.

    Documents are narrowed to the queries' terms and written. The queries go out in blocks. About ``first`` documents, those
    with most terms, are counted against every query, which gives each a bound: its k-th overlap there. A document that
    reaches the bound b of a query of m terms has one of its m - b + 1 rarest, so the others are only compared with
    queries of which they have such a term. That loses nothing. Rows that share an id add up, and are then all counted.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    asked = queries.where(F.size("t") > 0).select("qid", "t").toArrow().combine_chunks()
    qids, lists = (pa.concat_arrays(asked.column(c).chunks or [pa.array([], asked.schema.field(c).type)]) for c in (0, 1))
    words = lists.flatten()
    vocabulary = words.unique()
    term, length = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    known = spark.sparkContext.broadcast(vocabulary)

    def narrow(batches):
        for batch in batches:
            v = batch.column(1)
            at = pc.index_in(v.flatten(), value_set=known.value)
            row = np.repeat(np.arange(len(v)), np.diff(v.offsets.to_numpy()))[pc.is_valid(at).to_numpy(zero_copy_only=False)]
            ends = np.cumsum([0, *np.bincount(row, minlength=len(v))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.drop_null())], ["id", "t"])

    held = docs.select(F.col("id").cast("long").alias("id"), "t").mapInArrow(narrow, "id long, t array<int>").withColumn("n", F.size("t"))
    held = written(held.where("n > 0"), "query-terms")
    df = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("t").alias("w")).groupBy("w").count().toArrow().to_batches():
        df[r.column(0).to_numpy()] = r.column(1).to_numpy()
    ids = held.agg(F.count("*"), F.count_distinct("id")).first()
    least_big = 0
    if ids[0] == ids[1]:
        of_size, n = held.groupBy("n").count().orderBy(F.desc("n")).collect(), 0
        for size, count in of_size:
            least_big, n = size, n + count
            if n >= first:
                break
    else:
        held = written(held.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t")).withColumn("n", F.size("t")), "merged")

    def posted(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries by term, and where each term's begin."""
        at = np.argsort(w, kind="stable")
        return q[at].astype(np.int32), np.searchsorted(w[at], np.arange(len(vocabulary) + 1))

    def each(batches):
        for batch in batches:
            ids, flat, ends = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
            for j in range(len(ids)):
                yield ids[j], flat[ends[j] - ends[0] : ends[j + 1] - ends[0]]

    def search(base: int, length: np.ndarray, term: np.ndarray) -> DataFrame:
        """The queries from place ``base`` on, by their numbers of terms and their terms."""
        n, q = len(length), np.repeat(np.arange(len(length)), length)
        all_of = spark.sparkContext.broadcast(posted(q, term))

        def whole(batches):
            (queries, start), best, rows = all_of.value, Best(np.arange(base, base + n), k), []
            full = max(1, TILE // n)

            def give():
                s = np.stack([c for _, c in rows], axis=1).astype(float)
                best.add(np.where(s >= least, s, -np.inf), np.array([i for i, _ in rows]))
                rows.clear()

            for i, w in each(batches):
                rows.append((i, np.bincount(queries[spread(start[w], start[w + 1] - start[w])], minlength=n).astype(np.int32)))
                if len(rows) == full:
                    give()
            if rows:
                give()
            yield best.batch()

        kind = "qid long, id long, score double"
        big = written(top(held.where(F.col("n") >= least_big).mapInArrow(whole, kind), "qid", k, F.desc("score"), "id").drop("rank"), "big")
        if not least_big:
            return big
        low = np.full(n, float(least))
        for r in big.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).toArrow().to_batches():
            low[r.column(0).to_numpy() - base] = r.column(2).to_numpy()
        # Within each query the rarest terms first; those beyond the m - b + 1 first find no document.
        at = np.lexsort((df[term], q))
        by_rarity = term[at]
        starts = np.cumsum(length) - length
        early = np.arange(len(q)) - starts[q] < (length - low + 1)[q]
        sent = spark.sparkContext.broadcast((posted(q[early], by_rarity[early]), low, starts, length, by_rarity))

        def rest(batches):
            (queries, start), low, starts, length, terms = sent.value
            best, has = Best(np.arange(base, base + n), k), np.zeros(len(start), np.int32)
            best.low = low.copy()
            for i, w in each(batches):
                some = np.unique(queries[spread(start[w], start[w + 1] - start[w])])
                if len(some):
                    has[w] = 1
                    m = length[some]
                    shared = np.add.reduceat(has[terms[spread(starts[some], m)]], np.cumsum(m) - m)
                    has[w] = 0
                    near = shared >= best.low[some]
                    best.put(some[near], shared[near].astype(float), np.full(int(near.sum()), i))
            yield best.batch()

        return big.union(held.where(F.col("n") < least_big).mapInArrow(rest, kind))

    ends = np.concatenate([[0], np.cumsum(length)])
    found = [search(a, length[a : a + block], term[ends[a] : ends[min(a + block, len(length))]]) for a in range(0, len(length), block)]
    if not found:
        return queries.select("qid").join(docs.select(F.col("id").cast("long")), F.lit(False)).select("qid", "id", F.lit(0).cast("long").alias("overlap"), F.lit(1).alias("rank"))
    names = spark.sparkContext.broadcast(qids)

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([names.value.take(batch.column(0)), *batch.columns[1:]], ["qid", "id", "overlap", "rank"])

    ranked = top(reduce(DataFrame.union, found), "qid", k, F.desc("score"), "id").select("qid", "id", F.col("score").cast("long").alias("overlap"), "rank")
    return ranked.mapInArrow(named, f"qid {queries.schema['qid'].dataType.simpleString()}, id long, overlap long, rank int")


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """qid, id, score, rank: sum of weight / (k + rank) over lists (qid, list_id, weight, id, rank).

    Ties keep the order of first appearance: the lowest list, then the rank in it.
    """
    # Lists keep their partitioning by query under a union, which the adaptive planner of 4.1 may then misjudge.
    lists.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    fused = lists.groupBy("qid", "id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("list_id", "rank")).alias("first")
    )
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "first"))).drop("first")


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """qid, id, rank of k candidates (qid, ord, id, rel, vec) chosen greedily for relevance less redundancy.

    Groups are windows of at most a few times k candidates. Redundancy is the highest cosine with a chosen
    one, at least 0; the earliest wins ties.
    """

    def choose(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("ord")
        ids, rel = t.column("id").to_pylist(), t.column("rel").to_numpy()
        x = np.array(t.column("vec").to_pylist(), np.float64)
        n = np.linalg.norm(x, axis=1)
        n[n == 0] = np.inf
        sims = (x / n[:, None]) @ (x / n[:, None]).T
        left, picked = list(range(len(ids))), []
        while left and len(picked) < k:
            score = [round(weight * rel[i] - (1 - weight) * max([0.0, *(sims[i, j] for j in picked)]), DIGITS) for i in left]
            picked.append(left.pop(int(np.argmax(score))))
        return pa.table({"qid": pa.array([key[0].as_py()] * len(picked), pa.int64()), "id": pa.array([ids[i] for i in picked], pa.int64()), "rank": pa.array(range(1, len(picked) + 1), pa.int32())})

    rows = candidates.select("qid", "ord", "id", F.col("rel").cast("double"), "vec")
    return rows.groupBy("qid").applyInArrow(choose, "qid long, id long, rank int")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, weight: float = 0.7) -> DataFrame:
    """qid, id, score, rank: dense and sparse lists fused, the first max(4k, k) with vectors reranked, the others after them.

    docs (id, text), vectors (id, vec), queries (qid, text, vec). Both lists are whole: every vector has a place in the
    one, every document with a query term in the other. Only those are fused that may be among the first 4k: what is
    beyond place 60 + 8k of both lists has a score below 2 / (120 + 8k), less than the place 4k of either alone gives.
    Their places in the other list are then counted exactly.
    """
    depth, lists, named = 60 + 8 * k, None, None
    scorers = dense_scorer(vectors, queries), bm25_scorer(docs, queries)
    found = [written(x.best(depth).select("qid", "id", "rank"), "list") for x in scorers]
    named = found[0].select("qid", "id").union(found[1].select("qid", "id")).distinct()
    for number, (x, known) in enumerate(zip(scorers, found, strict=True)):
        late = written(named.join(known, ["qid", "id"], "left_anti"), "late")
        each = known.union(x.places(late)).select("qid", F.lit(number).alias("list_id"), F.lit(1.0).alias("weight"), "id", "rank")
        lists = each if lists is None else lists.union(each)
    fused = written(rrf(lists).withColumnRenamed("rank", "ord"), "fused")
    named = fused.join(vectors, "id", "left").join(queries.select("qid", F.col("vec").alias("qv")), "qid")
    window = named.where("vec is not null").withColumn("w", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))).where(F.col("w") <= 4 * k)
    chosen = mmr(window.select("qid", "ord", "id", F.round(cosine(F.col("vec"), F.col("qv")), DIGITS).alias("rel"), "vec"), k, weight)
    tail = fused.join(chosen, ["qid", "id"], "left_anti").select("qid", "id", (F.col("ord") + 1_000_000).alias("at"))
    listed = chosen.select("qid", "id", F.col("rank").alias("at")).union(tail)
    ranked = top(listed, "qid", k, "at")
    return ranked.join(fused.select("qid", "id", "score"), ["qid", "id"]).select("qid", "id", "score", "rank")
