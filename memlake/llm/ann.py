"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted to a bounded sample of rows and broadcast; every row is filed under a leaf. A query goes
down the tree with a priority queue of nodes, nearest upper bound of the inner product first, and so visits
leaves in a best-first order; it widens the visit until the number of leaves that a calibration needed, and
beyond that until they hold as many rows as are asked for. That
calibration searches a bounded set of queries exactly, over all rows, and takes the least number of leaves
at which the mean recall reaches RECALL. Leaves are searched in blocks of rows as matrix products, each
query's candidates of a block are cut to the k best, and the best of all blocks are ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, written

#: Rows of the sample that the tree is fitted to, and of queries that it is calibrated with.
FIT_ROWS = 100_000
CALIBRATION_QUERIES = 256
RECALL = 0.95
BRANCHES = 8
#: A tree over n rows has the square root of n leaves, at any size, up to so many (it holds at most twice as many centres).
MOST_LEAVES = 32_768
#: Rows of a leaf that one task searches at once.
BLOCK_ROWS = 20_000
#: Queries that one task compares with a block of a leaf; a leaf that more visit is dealt to more tasks.
QUERY_ROWS = 20_000
VECTOR = "array<double>"


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of at most k groups of rows; equal rows never give two groups."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.sum() > 1e-18:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        c = np.array([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * (x @ c.T), axis=1)


class Tree:
    """Nodes as arrays: centre, children (empty: a leaf, numbered from 0), and the farthest fitted row of a node."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.centre, self.children, self.leaf, self.radius = [sample.mean(axis=0)], [[]], [-1], [0.0]
        rng = np.random.default_rng(seed)
        rows = {0: np.arange(len(sample))}
        self.radius[0] = float(np.sqrt(((sample - self.centre[0]) ** 2).sum(axis=1).max()))
        n_leaves, final = 1, set()
        # The largest leaf is divided first, until there are enough.
        heap = [(-len(sample), 0)]
        while heap and n_leaves < leaves:
            _, node = heapq.heappop(heap)
            own = rows[node]
            c = kmeans(sample[own], min(BRANCHES, len(own), leaves - n_leaves + 1), rng) if len(own) > 1 else np.zeros((1, 1))
            if len(c) < 2:
                final.add(node)
                continue
            part = nearest(sample[own], c)
            for j in range(len(c)):
                inside = own[part == j]
                if not len(inside):
                    continue
                new = len(self.centre)
                self.centre.append(c[j])
                self.children.append([])
                self.leaf.append(-1)
                self.radius.append(float(np.sqrt(((sample[inside] - c[j]) ** 2).sum(axis=1).max())))
                self.children[node].append(new)
                rows[new] = inside
                heapq.heappush(heap, (-len(inside), new))
            n_leaves += len(self.children[node]) - 1
            del rows[node]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        leaves_at = [k for k, c in enumerate(self.children) if not c]
        for number, node in enumerate(leaves_at):
            self.leaf[node] = number
        self.leaves = len(leaves_at)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at each level."""
        node = np.zeros(len(x), np.int64)
        todo = np.arange(len(x))
        while len(todo):
            for n in np.unique(node[todo]):
                here = todo[node[todo] == n]
                if self.children[n]:
                    kids = np.array(self.children[n])
                    node[here] = kids[nearest(x[here], self.centre[kids])]
            todo = np.array([i for i in todo if self.children[node[i]]], np.int64) if len(todo) else todo
        return np.array(self.leaf)[node]

    def visit(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones until they hold ``least`` of ``rows`` (by leaf).

        A node's key is q's inner product with its centre plus a share of |q| times its radius, which leans the
        order to wide bins in which a better row may lie.
        """
        norm = 0.5 * float(np.sqrt(q @ q))
        bound = self.centre @ q + norm * self.radius
        queue, found, held = [(-bound[0], 0)], [], 0
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-bound[kid], kid))
            else:
                found.append(self.leaf[node])
                held += 0 if rows is None else int(rows[self.leaf[node]])
        return found


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part.

    Null vectors, zero vectors and those that hold a null or a component that isn't finite don't; nor do
    vectors of another length than the commonest (the shorter of equally common ones), nor rows without a vec_id.
    """
    v = F.col("embedding").cast(VECTOR)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (common[0] if common else 0))


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id, best first."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest scores of each row, best first, ties to the left."""
    parts = [np.argsort(-score[:, c : c + 1024], axis=1, kind="stable")[:, :k] + c for c in range(0, score.shape[1], 1024)]
    at = np.concatenate(parts, axis=1)
    if len(parts) > 1:
        order = np.argsort(-np.take_along_axis(score, at, 1), axis=1, kind="stable")[:, :k]
        at = np.take_along_axis(at, order, 1)
    return at


def exact(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of each row of q with the rows of x that ``at`` names, in double precision, by component in order."""
    total = np.zeros(at.shape)
    for j in range(q.shape[1]):
        total += q[:, j, None] * x[at, j]
    return total


class Index:
    """Every row filed under a leaf, in blocks, in a written table; the tree; and the leaves that a search visits."""

    def __init__(self, vectors: DataFrame, k: int = 20, recall: float = RECALL):
        spark = vectors.sparkSession
        short_batches(spark)
        self.k, self.spark = k, spark
        self.rows = written(usable(vectors), "vectors")
        n = self.rows.count()
        self.empty = n == 0
        if self.empty:
            return
        draw = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = self.rows.where(draw < min(1.0, FIT_ROWS / n)).select("v").limit(2 * FIT_ROWS).toArrow()
        points = _matrix(sample.column("v").combine_chunks())
        if not len(points):
            points = _matrix(self.rows.select("v").limit(1).toArrow().column("v").combine_chunks())
        self.tree = Tree(points, max(1, min(MOST_LEAVES, round(n**0.5))))
        self.sent = spark.sparkContext.broadcast(self.tree)
        sent = self.sent

        @F.arrow_udf("int")
        def leaf(v: pa.Array) -> pa.Array:
            return pa.array(sent.value.file(_matrix(v)), pa.int32())

        filed = self.rows.select("vec_id", "v", leaf("v").alias("leaf"))
        sizes = {r[0]: r[1] for r in filed.groupBy("leaf").count().collect()}
        self.sizes = np.array([sizes.get(k, 0) for k in range(self.tree.leaves)])
        self.blocks = {leaf_: max(1, -(-c // BLOCK_ROWS)) for leaf_, c in sizes.items()}
        many = spark.createDataFrame(list(self.blocks.items()), "leaf int, blocks int")
        self.filed = written(
            filed.join(F.broadcast(many), "leaf").select(
                "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v"
            ),
            "filed",
        )
        self.visits = self._calibrate(recall)

    def _calibrate(self, recall: float) -> int:
        """The least number of leaves at which a set of queries reaches the mean recall over all rows."""
        draw = F.xxhash64(F.lit(3), "vec_id", "v")
        table = self.rows.orderBy(draw).limit(CALIBRATION_QUERIES).toArrow()
        ids, q = table.column("vec_id").to_numpy(), _matrix(table.column("v").combine_chunks())
        sent, k = self.spark.sparkContext.broadcast((ids, q)), self.k

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            kept: list[list[tuple]] = [[] for _ in ids]
            for batch in batches:
                x, own, leaf = _matrix(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                product = q @ x.T
                for j in range(len(ids)):
                    s = np.where(own == ids[j], -np.inf, product[j])
                    top = _top(s, own, k)
                    kept[j] = heapq.nsmallest(k, kept[j] + [(-s[i], int(own[i]), int(leaf[i])) for i in top if s[i] > -np.inf])
            rows = [(j, *x) for j, held in enumerate(kept) for x in held]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = (pa.int32(), pa.float64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["q", "d", "vec_id", "leaf"])

        found = self.filed.select("v", "vec_id", "leaf").mapInArrow(best, "q int, d double, vec_id long, leaf int")
        ranked = Window.partitionBy("q").orderBy("d", "vec_id")
        truth = found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).select("q", "leaf").collect()
        place = []
        for j in range(len(ids)):
            order = {leaf: at for at, leaf in enumerate(self.tree.visit(q[j], self.tree.leaves))}
            place += [order[r[1]] + 1 for r in truth if r[0] == j]
        if not place:
            return 1
        place.sort()
        return place[min(len(place) - 1, int(np.ceil(recall * len(place))))]

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of ``queries`` (vec_id, v); a row never finds its own vec_id.

        Rows of one vec_id are one query, by the least of their vectors. Every row of the index is a candidate,
        so a repeated one may be found twice.
        """
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sent, visits, k, sizes = self.sent, self.visits, self.k, self.sizes
        # Of k + 1 rows per copy of the query's own vec_id at least k are others.
        own = self.filed.groupBy("vec_id").count().where("count > 1")

        @F.arrow_udf("array<int>")
        def leaves(v: pa.Array, copies: pa.Array) -> pa.Array:
            asked = zip(_matrix(v), copies.to_pylist(), strict=True)
            return pa.array([sent.value.visit(q, visits, sizes, k + c) for q, c in asked], pa.list_(pa.int32()))

        once = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
        once = once.join(own.select(F.col("vec_id").alias("query_id"), "count"), "query_id", "left")
        once = written(once.select("query_id", "v", leaves("v", F.coalesce("count", F.lit(1))).alias("leaves")), "queries")
        visited = once.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
        # One row a leaf, so at most MOST_LEAVES.
        dealt = [(r[0], self.blocks[r[0]], -(-r[1] // QUERY_ROWS)) for r in visited.collect() if r[0] in self.blocks]
        dealt = F.broadcast(self.spark.createDataFrame(dealt, "leaf int, blocks int, parts int"))
        turns = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = once.select("query_id", "v", F.explode("leaves").alias("leaf")).join(dealt, "leaf")
        asked = asked.withColumn("block", turns("blocks")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        filed = self.filed.join(dealt.select("leaf", "parts"), "leaf").withColumn("part", turns("parts"))

        def compare(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            if left.num_rows and right.num_rows:
                x, own = _matrix(right.column("v").combine_chunks()), right.column("vec_id").to_numpy()
                by_id = np.argsort(own, kind="stable")
                x, own = x[by_id], own[by_id]
                asks, of = _matrix(left.column("v").combine_chunks()), left.column("query_id").to_numpy()
                for at in range(0, len(of), 512):
                    q, ids = asks[at : at + 512], of[at : at + 512]
                    # Equal vectors get equal rounded scores; a few more than k are added up anew, exactly.
                    score = np.round(q @ x.T, 12)
                    score[own == ids[:, None]] = -np.inf
                    top = np.sort(best(score, k + 8), axis=1)
                    e = np.where(np.take_along_axis(score, top, 1) > -np.inf, exact(q, x, top), -np.inf)
                    rank = np.argsort(-e, axis=1, kind="stable")[:, :k]
                    e, top = np.take_along_axis(e, rank, 1), np.take_along_axis(top, rank, 1)
                    row, place = np.nonzero(e > -np.inf)
                    for held, found in zip(out, (ids[row], own[top[row, place]], e[row, place]), strict=True):
                        held.append(found)
            cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        near = (
            asked.select("leaf", "block", "part", "query_id", "v")
            .groupBy("leaf", "block", "part")
            .cogroup(filed.groupBy("leaf", "block", "part"))
            .applyInArrow(compare, "query_id long, vec_id long, score double")
        )
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of every row whose vec_id is divisible by 20."""
    index = Index(vectors, 20)
    return index.search(index.rows.where(F.col("vec_id") % 20 == 0)) if not index.empty else index.search(vectors)
