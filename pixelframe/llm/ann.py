"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stop.

Vectors get one more component that brings all of a tree to the same norm, and queries are
scaled to that norm, so the largest inner product is the smallest Euclidean distance.  A Gaussian
(2-stable) matrix projects them to a few dimensions, where the squared distance of a pair is its
true squared distance times a chi-square variable.  The projections of a shard are indexed by
a kd-tree.  A query walks it best first: of the nodes at hand the one closest to it in
the projection is taken; an inner node is replaced by its children, the rows of a leaf
come in as projected neighbours, and those within the stop radius are verified by exact
inner products.  The stop radius is the distance beyond which the chance that an unseen
row beats the k-th best is below 1 - p: the k-th best squared distance times the chi-square quantile.
The walk ends when the closest node lies beyond it.

Queries are broadcast in rounds of bounded size, each task indexes its own rows shard by
shard (every row is indexed, none is shuffled) and takes the k-th best on to its next shard, and the
best k of all tasks are merged.  Where norms differ much, a shard has a tree for each range of norms.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part (neither as query nor as candidate); vectors of another dimension than the query are no
candidates of it; rows of a query's own id are never its neighbours; repeated rows are candidates
each; equal query rows ask once, and rows of one id with different vectors each get a list of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm import scratch

#: Rows of a shard, bytes of queries that are broadcast at a time, queries that walk together.
SHARD_ROWS, ROUND_BYTES, TOGETHER = 32_768, 1 << 25, 256
DIMENSIONS, LEAF, CONFIDENCE = 20, 64, 0.9
#: Trees of a shard by norm, and the ratio of the largest norm to the median one from which there are several.
RANGES, SPREAD = 4, 1.05


def chi_square_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom."""
    low, high = 0.0, 10.0 * m + 200
    for _ in range(80):
        x = (low + high) / 2
        tail, term = 0.0, math.exp(-x / 2)
        for i in range(m // 2):
            tail += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


class KdTree:
    """Halves at the median of the widest side; a node has a box, a leaf a run of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.start, self.stop, self.left, low, high = [0], [len(points)], [], [], []
        node = 0
        while node < len(self.start):
            a, b = self.start[node], self.stop[node]
            own = points[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if b - a > leaf:
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, (high[-1] - low[-1]).argmax()], half)]
                self.left.append(len(self.start))  # the right child follows it
                self.start += [a, a + half]
                self.stop += [a + half, b]
            else:
                self.left.append(-1)
            node += 1
        self.start, self.stop, self.left = (np.array(x) for x in (self.start, self.stop, self.left))
        self.low, self.high = np.stack(low), np.stack(high)


class Asked:
    """Queries of one dimension and the best that each has found."""

    def __init__(self, asks: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
        self.asks, self.ids, self.q, self.k = asks, ids, q, k
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.best = np.full((len(q), k), -np.inf)
        self.best_id = np.zeros((len(q), k), np.int64)
        self.verified = 0

    def take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge results (query number, id, score)."""
        asked = np.unique(who)
        q = np.concatenate([np.repeat(asked, self.k), who])
        i = np.concatenate([self.best_id[asked].ravel(), ids])
        s = np.concatenate([self.best[asked].ravel(), scores])
        order = np.lexsort((i, -s, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.best_id[asked], self.best[asked] = i[order].reshape(-1, self.k), s[order].reshape(-1, self.k)


def search_shard(ids: np.ndarray, x: np.ndarray, asked: Asked, m: int = DIMENSIONS, p: float = CONFIDENCE) -> None:
    """Let all queries search the rows of one shard."""
    norm = np.sqrt((x * x).sum(axis=1))
    parts = RANGES if norm.max() > SPREAD * np.median(norm) else 1
    for part in np.array_split(np.argsort(-norm, kind="stable"), parts):
        if len(part):
            _search_tree(ids[part], x[part], float(norm[part].max()), asked, m, p)


def _search_tree(ids: np.ndarray, x: np.ndarray, norm: float, asked: Asked, m: int, p: float) -> None:
    g = np.random.default_rng(11).normal(size=(x.shape[1] + 1, m))
    lift = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    points = x @ g[:-1] + lift[:, None] * g[-1]
    tree = KdTree(points)
    ids, x, points = ids[tree.order], x[tree.order], points[tree.order]
    quantile = chi_square_quantile(p, m)
    width = int((tree.stop - tree.start)[tree.left < 0].max())
    for first in range(0, len(asked.q), TOGETHER):
        q = np.arange(first, min(first + TOGETHER, len(asked.q)))
        scale = norm / asked.norm[q]
        at = (asked.q[q] * scale[:, None]) @ g[:-1]
        bound = np.full((len(q), len(tree.left)), np.inf)  # infinite: not at hand, or done
        bound[:, 0] = 0
        alive = np.arange(len(q))
        while len(alive):
            node = bound[alive].argmin(axis=1)
            radius = np.maximum(2 * norm * norm - 2 * scale[alive] * asked.best[q[alive], -1], 0) * quantile  # infinite until k are found
            go = bound[alive, node] <= np.minimum(radius, np.finfo(float).max)
            alive, node, radius = alive[go], node[go], radius[go]
            bound[alive, node] = np.inf
            inner = tree.left[node] >= 0
            for child in (0, 1):
                new = tree.left[node[inner]] + child
                away = np.maximum(np.maximum(tree.low[new] - at[alive[inner]], at[alive[inner]] - tree.high[new]), 0)
                bound[alive[inner], new] = (away * away).sum(axis=1)
            who, leaf = alive[~inner], node[~inner]
            if not len(who):
                continue
            rows = tree.start[leaf][:, None] + np.arange(width)
            inside = rows < tree.stop[leaf][:, None]
            rows = np.minimum(rows, len(ids) - 1)
            gap = points[rows] - at[who][:, None, :]
            near = inside & ((gap * gap).sum(axis=2) <= radius[~inner][:, None]) & (ids[rows] != asked.ids[q[who]][:, None])
            a, b = np.nonzero(near)
            score = np.einsum("rd,rd->r", x[rows[a, b]], asked.q[q[who[a]]])
            asked.verified += len(score)
            better = score >= asked.best[q[who[a]], -1]
            if better.any():
                asked.take(q[who[a[better]]], ids[rows[a, b][better]], score[better])


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, start, length) of an array of lists."""
    size = np.asarray(lists.value_lengths())
    return np.asarray(lists.flatten()), np.cumsum(size) - size, size


def pass_rows(rows: DataFrame, asking: pa.Table, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(ask, query_id, id, score): each task's best ``k`` of ``rows`` (id, v) for the queries (ask, id, v)."""
    shared = rows.sparkSession.sparkContext.broadcast([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in asking.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, q_ids, lists = shared.value
        asks, q_ids = np.asarray(asks), np.asarray(q_ids)
        flat, start, size = _matrix(lists)
        groups = {int(d): Asked(asks[size == d], q_ids[size == d], flat[start[size == d][:, None] + np.arange(d)], k) for d in np.unique(size)}
        held: dict[int, list] = {}
        n: dict[int, int] = {}

        def settle(d: int) -> None:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            n[d] = 0
            search_shard(ids, x, groups[d])

        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                ids = np.asarray(part.column(0))
                flat, start, size = _matrix(part.column(1))
                for d in np.unique(size).tolist():
                    if d in groups:
                        own = size == d
                        if n.get(d, 0) and n[d] + own.sum() > shard_rows:
                            settle(d)
                        held.setdefault(d, []).append((ids[own], flat[start[own][:, None] + np.arange(d)]))
                        n[d] = n.get(d, 0) + int(own.sum())
        for d in list(held):
            settle(d)
        for asked in groups.values():
            who, nth = np.nonzero(asked.best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked.asks[who]), pa.array(asked.ids[who]), pa.array(asked.best_id[who, nth]), pa.array(asked.best[who, nth])], names=["ask", "query_id", "id", "score"])

    return rows.mapInArrow(run, "ask long, query_id long, id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """The ``k`` rows of largest inner product for each row that fulfils ``queries``.

    Columns: query_id, rank (from 1), the id column of the neighbour, score.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), queries.alias("asks")).where(F.col("id").isNotNull() & fine)
    rows = base.select("id", "v")
    n = rows.count()
    rows = rows.coalesce(max(1, -(-n // shard_rows)))
    asking = base.where("asks").select("id", "v").distinct().withColumn("part", F.spark_partition_id()).withColumn("ask", F.monotonically_increasing_id())
    asking = scratch.table(asking, "asking")
    # Rounds of queries: whole numbers of a table's parts, cut further where a part is large.
    sizes = asking.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 16).alias("bytes")).orderBy("part").collect()
    rounds: list[list] = []
    room = 0
    for r in sizes:
        pieces = -(-r["bytes"] // round_bytes)
        if r["bytes"] > room or pieces > 1:
            rounds += [[(r["part"], i, pieces)] for i in range(pieces)]
            room = round_bytes - r["bytes"] if pieces == 1 else 0
        else:
            rounds[-1].append((r["part"], 0, 1))
            room -= r["bytes"]
    found = []
    for some in rounds:
        part, i, pieces = some[0]
        mine = F.col("part").isin([p for p, _, _ in some]) & (F.pmod(F.xxhash64("ask"), F.lit(pieces)) == i)
        found.append(pass_rows(rows, asking.where(mine).select("ask", "id", "v").toArrow(), k, shard_rows))
        if len(rounds) > 1:
            found[-1] = scratch.table(found[-1], "found")
    every = found[0] if found else spark.createDataFrame([], "ask long, query_id long, id long, score double")
    for more in found[1:]:
        every = every.union(more)
    w = Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    ranked = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
