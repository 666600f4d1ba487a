"""Exact top-k by inner product: M-trees over shards of the vectors, searched best first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick

#: Added to distances and bounds for rounding; scores themselves are whole numbers.
SLACK = 1e-6


class MTree:
    """Nodes are pages: leaves hold vectors, others hold children, each with a router, a covering radius and its
    distance to the parent's router.

    For a query q, no vector y of a page with router c and radius r scores over q.c + |q| r, since q.(y - c) <= |q| |y - c|.
    Before q.c is worked out, the stored distance d to the parent's router p, for which q.p is known, bounds it by
    q.p + |q| (d + r); a page that this rules out costs no computation. A leaf's vectors are ruled out the same way.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = 256, fan: int = 16, seed: int = 1) -> None:
        self.vectors, self.ids = vectors, ids
        self.root = np.zeros(vectors.shape[1])
        self.root_radius = 0.0
        #: Of a page of children: their places, routers, radii and distances to the page's router.
        self.children: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None] = []
        #: Of a leaf: where its vectors begin and end, nearest to its router first, and their distances to it.
        self.members: list[tuple[int, int, np.ndarray] | None] = []
        self.computed, self.order, self.filled = 0, [], 0
        if len(vectors):
            self.root = vectors.mean(axis=0)
            self.root_radius = self._build(np.arange(len(vectors)), self.root, page, fan, np.random.default_rng(seed))[1]
            order = np.concatenate(self.order)  # leaves lie one after the other
            self.vectors, self.ids, self.order = vectors[order], ids[order], []

    def _build(self, members: np.ndarray, router: np.ndarray, page: int, fan: int, rng: np.random.Generator) -> tuple[int, float]:
        """(place, covering radius) of a new node."""
        node = len(self.members)
        far = np.sqrt(((self.vectors[members] - router) ** 2).sum(axis=1))
        self.children.append(None)
        self.members.append(None)
        if len(members) <= page or far.max() == 0:
            near = np.argsort(far)
            self.order.append(members[near])
            self.members[node] = (self.filled, self.filled + len(members), far[near])
            self.filled += len(members)
        else:
            parts = self._parts(members, min(fan, max(2, -(-2 * len(members) // page))), rng)
            routers = np.array([self.vectors[p].mean(axis=0) for p in parts])
            built = [self._build(p, c, page, fan, rng) for p, c in zip(parts, routers, strict=True)]
            away = np.sqrt(((routers - router) ** 2).sum(axis=1))
            self.children[node] = (np.array([b[0] for b in built]), routers, np.array([b[1] for b in built]), away)
        return node, float(far.max())

    def _parts(self, members: np.ndarray, fan: int, rng: np.random.Generator) -> list[np.ndarray]:
        """Members by nearest of up to ``fan`` pivots drawn from them; copies of a pivot don't count as another."""
        pivots = np.unique(self.vectors[rng.choice(members, min(fan, len(members)), replace=False)], axis=0)
        if len(pivots) == 1:
            far = ((self.vectors[members] - pivots[0]) ** 2).sum(axis=1)
            pivots = np.stack((pivots[0], self.vectors[members[np.argmax(far)]]))
        x = self.vectors[members]
        which = np.argmin((pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T), axis=1)
        return [members[which == i] for i in range(len(pivots)) if (which == i).any()]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): up to ``k`` of the highest scores of each query, ties to the smaller id, its own id left out.

        Each query goes best first: in every round it opens the page that promises it most, until none promises what its
        k-th score is by then. Queries that open the same page in a round share one matrix product. Vectors that can't
        reach ``least`` may be left out.
        """
        m = len(queries)
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not len(self.ids) or not m:
            return held
        norm, bar = np.sqrt((queries * queries).sum(axis=1)), least.astype(float)
        upto, product = np.full((m, len(self.members)), -np.inf), np.zeros((m, len(self.members)))
        product[:, 0] = queries @ self.root
        upto[:, 0] = product[:, 0] + norm * self.root_radius
        while True:
            page = np.argmax(upto, axis=1)
            best = upto[np.arange(m), page]
            open_ = np.flatnonzero(np.isfinite(best))
            open_ = open_[best[open_] + SLACK * (1 + np.abs(best[open_])) >= bar[open_]]
            if not len(open_):
                return held
            new = [held]
            for node in np.unique(page[open_]).tolist():
                mine = open_[page[open_] == node]
                upto[mine, node] = -np.inf
                if self.members[node] is None:
                    self._children(node, mine, queries, norm, bar, upto, product)
                else:
                    new.append(self._leaf(node, mine, queries, norm, own, k, bar, product))
            if len(new) > 1:
                held = highest(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
                at = np.arange(k - 1, len(held[0]))
                at = at[held[0][at] == held[0][at - k + 1]]  # the k-th of a query
                bar[held[0][at]] = np.maximum(bar[held[0][at]], held[2][at])

    def _children(self, node: int, mine: np.ndarray, queries: np.ndarray, norm: np.ndarray, bar: np.ndarray, upto: np.ndarray, product: np.ndarray) -> None:
        nodes, routers, radii, away = self.children[node]
        first = product[mine, node][:, None] + norm[mine][:, None] * (away + radii)[None, :]
        can = first + SLACK * (1 + np.abs(first)) >= bar[mine][:, None]
        some = np.flatnonzero(can.any(axis=0))
        found = queries[mine] @ routers[some].T
        self.computed += found.size
        product[np.ix_(mine, nodes[some])] = found
        upto[np.ix_(mine, nodes[some])] = np.where(can[:, some], found + norm[mine][:, None] * radii[some][None, :], -np.inf)

    def _leaf(self, node: int, mine: np.ndarray, queries: np.ndarray, norm: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last, far = self.members[node]
        upto = product[mine, node] + norm[mine] * far[:, None]
        first += int(np.argmax(np.append((upto + SLACK * (1 + np.abs(upto)) >= bar[mine]).any(axis=1), True)))
        if first == last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        scores, ids = queries[mine] @ self.vectors[first:last].T, self.ids[first:last]
        self.computed += scores.size
        scores[own[mine][:, None] == ids[None, :]] = -np.inf
        floor = bar[mine]
        if len(ids) > k:  # no more than k of a page can matter, and those that tie with the last
            floor = np.maximum(floor, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        row, at = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        return mine[row], ids[at], scores[row, at]


def highest(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query, ties to the smaller id; by query, from the highest."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], scores[keep]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component x as a double. Without vectors that are null or have no
    component, or one that is null or not finite, and without rows of null id."""
    rows = pick(vectors, vec_id=id_col, v=vector_col).where("vec_id is not null and v is not null").withColumn("v", F.col("v").cast("array<double>"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(fine & (F.size("v") > 0)).select(F.col("vec_id").cast("long"), F.transform("v", lambda x: F.floor(x * factor).cast("double")).alias("v"))


def dense(column: pa.Array, size: int) -> np.ndarray:
    return column.combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, size) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    factor: int = 256,
    shard: int = 8192,
    most_pivots: int = 2048,
    most_queries: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product for each id divisible by ``every``.

    Vectors go to the nearest of a bounded number of pivots (about one for ``shard`` vectors, ``most_pivots`` at most,
    those of least hash); a pivot with more than ``shard`` vectors, copies of one say, is divided by a hash of the id.
    Each shard becomes an M-tree. A query first searches the shard that promises most; the k-th score found there is a
    bar, and only shards whose bound reaches it are searched too. The result is exact. Where over ``most_queries``
    queries meet in a shard, they are dealt by a hash over as many copies of it as that needs, so a task has at most
    ``shard`` vectors and about ``most_queries`` queries.

    Ties go to the smaller id. Components count as floor(factor * x), in 64-bit arithmetic that is exact for them;
    vectors null, empty or with a component null or not finite take no part, nor do rows without an id; vectors of
    another length than the most common one (of equals the longest) take no part either. Fewer than ``k`` candidates
    give as many rows; an empty table gives none. Rows that repeat an id are candidates each, and as queries answer
    once, by the first in the order of their components.
    """
    spark = vectors.sparkSession
    rows = checkpoint(whole_numbers(vectors, id_col, vector_col, factor))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if sizes is None:
        return empty
    d, n = sizes.d, sizes.n
    rows = rows.where(F.size("v") == d)
    wanted = int(min(most_pivots, max(1, round(n / shard))))
    hashed = rows.select("v", F.xxhash64("v").alias("h"))
    passed = hashed.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, 16 * wanted / n) * (1 << 30)))
    for some in (passed, hashed):  # none may pass where most vectors are copies
        drawn = some.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(wanted).toArrow()
        if drawn.num_rows:
            break
    pivots = dense(drawn.column("v"), d)
    pivots_ = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots_.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch.column("v"), d)
            home = np.argmin((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T), axis=1)
            far = np.sqrt(((x - p[home]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(home.astype(np.int64)), pa.array(far)], ["vec_id", "v", "home", "far"])

    placed = checkpoint(rows.mapInArrow(nearest, "vec_id long, v array<double>, home long, far double"))
    found = placed.groupBy("home").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pivot at most
    radius = np.full(len(pivots), -np.inf)
    parts = np.zeros(len(pivots), np.int64)
    for r in found:
        radius[r.home], parts[r.home] = r.radius, -(-r.n // shard)
    starts = np.cumsum(parts) - parts
    starts_ = F.array(*[F.lit(int(x)) for x in starts])
    parts_ = F.array(*[F.lit(int(max(x, 1))) for x in parts])
    at = (F.col("home") + 1).cast("int")
    sharded = placed.withColumn("shard", F.element_at(starts_, at) + F.pmod(F.xxhash64("vec_id"), F.element_at(parts_, at)))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = pivots_.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = dense(batch.column("v"), d)
                upto = q @ p.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
                if first:
                    go = np.zeros(upto.shape, bool)
                    go[np.arange(len(q)), np.argmax(upto, axis=1)] = True
                else:
                    bar = batch.column("bar").to_numpy(zero_copy_only=False)[:, None]
                    go = upto + SLACK * (1 + np.abs(upto)) >= bar
                    go[np.arange(len(q)), np.argmax(upto, axis=1)] = False
                    go &= np.isfinite(upto)
                row, home = np.nonzero(go)
                row = np.repeat(row, parts[home])
                shards = np.concatenate([np.arange(starts[h], starts[h] + parts[h]) for h in home]) if len(home) else np.zeros(0, np.int64)
                pick_ = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pick_), batch.column("v").take(pick_), batch.column("bar").take(pick_), pa.array(shards)], ["vec_id", "v", "bar", "shard"])

        return run

    def search(_, data, asked):
        query, ids, scores = (np.zeros(0, np.int64),) * 3
        if data.num_rows and asked.num_rows:
            order = np.argsort(data.column("vec_id").to_numpy(), kind="stable")
            tree = MTree(dense(data.column("v"), d)[order], data.column("vec_id").to_numpy()[order])
            own = asked.column("vec_id").to_numpy()
            found, ids, scores = tree.search(dense(asked.column("v"), d), own, k, asked.column("bar").to_numpy())
            query = own[found]
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores.astype(np.int64))})

    def answers(asked: DataFrame, first: bool) -> DataFrame:
        routed = asked.mapInArrow(route(first), "vec_id long, v array<double>, bar double, shard long")
        # A row for each shard that more queries ask than a task takes.
        hot = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most_queries).alias("copies")).where("copies > 1")
        hot = F.broadcast(checkpoint(hot))
        copies = F.coalesce("copies", F.lit(1).cast("long"))
        routed = routed.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("vec_id"), copies))
        data = sharded.select("shard", "vec_id", "v").join(hot, "shard", "left")
        data = data.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "vec_id", "v")
        routed = routed.select("shard", "copy", "vec_id", "v", "bar")
        return data.groupBy("shard", "copy").cogroup(routed.groupBy("shard", "copy")).applyInArrow(search, "query_id long, vec_id long, score long")

    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    nothing = F.lit(float("-inf")).alias("bar")
    opened = checkpoint(answers(queries.select("vec_id", "v", nothing), True))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    kth = opened.withColumn("r", rank).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    later = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
    every_one = opened.unionByName(answers(later, False))
    return every_one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

