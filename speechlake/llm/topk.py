"""Exact top-k by inner product: an M-tree searched best first.

With M the largest norm of all vectors, adding the coordinate sqrt(M^2 - |v|^2) to a stored vector and 0 to a query
makes the squared distance |q|^2 + M^2 - 2 q.v, so the nearest stored vector has the highest inner product, and a
metric tree applies. Stored vectors are dealt to shards; a shard's tree has nodes (pages) with a routing vector, a
covering radius and every entry's distance to its parent. A query takes pages in the order of their lower bounds; a
page or an entry that the stored distances already rule out is never computed. Bounds only skip work: scores are
exact integers, and equal scores are kept, so ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored vectors of a shard, queries of a block, entries of a leaf page and of an inner page.
SHARD, QUERY_BLOCK, LEAF, FAN = 16_384, 4_096, 128, 16
SCALE = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) with integer components; null vectors and those with null or non-finite components go, and rows without an id."""
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("raw"))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return raw.where("vec_id is not null and raw is not null").where(~bad).select("vec_id", F.transform("raw", lambda x: F.floor(x * SCALE)).alias("vec"))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while they are exact there, in whole numbers beyond."""
    most = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * max(1, a.shape[-1])
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class MTree:
    """Pages over one shard: leaves of vectors, and levels of inner pages above them."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, most: int, leaf: int = LEAF, fan: int = FAN):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vecs, self.most = ids[order], vecs[order], most
        self.norms = (self.vecs.astype(np.float64) ** 2).sum(1)
        groups = self._split(np.arange(len(ids)), leaf)
        self.pages = [self._leaf(g) for g in groups]
        self.leaves = len(self.pages)
        level = list(range(self.leaves))
        while len(level) > fan:
            level = [self._inner([level[i] for i in g]) for g in self._split_pages(level, fan)]
        self.top = level

    def _distance(self, a: np.ndarray, b: int) -> np.ndarray:
        """Distances of stored vectors in the augmented space."""
        extra = np.sqrt(np.maximum(0, self.most - self.norms))
        d = ((self.vecs[a].astype(np.float64) - self.vecs[b]) ** 2).sum(1) + (extra[a] - extra[b]) ** 2
        return np.sqrt(d)

    def _split(self, rows: np.ndarray, size: int) -> list[np.ndarray]:
        """Halve by the nearer of two far-apart vectors until the groups fit a page."""
        out, todo = [], [rows]
        while todo:
            g = todo.pop()
            if len(g) <= size:
                out.append(g)
                continue
            a = g[np.argmax(self._distance(g, g[0]))]
            da = self._distance(g, a)
            gap = da - self._distance(g, g[np.argmax(da)])
            side = np.argsort(gap, kind="stable")
            cut = min(max(int((gap < 0).sum()), len(g) // 4), len(g) - len(g) // 4)
            todo += [g[side[:cut]], g[side[cut:]]]
        return out

    def _split_pages(self, level: list[int], size: int) -> list[list[int]]:
        routers = np.array([self.pages[p][0] for p in level])
        at = {int(r): i for i, r in enumerate(routers)}
        return [[at[int(r)] for r in g] for g in self._split(routers, size)] if len(at) == len(level) else [list(range(i, min(i + size, len(level)))) for i in range(0, len(level), size)]

    def _leaf(self, rows: np.ndarray) -> tuple:
        middle = self.vecs[rows].astype(np.float64).mean(0)
        router = int(rows[np.argmin(((self.vecs[rows] - middle) ** 2).sum(1))])
        d = self._distance(rows, router)
        return router, float(d.max()), rows, d

    def _inner(self, children: list[int]) -> int:
        routers = np.array([self.pages[c][0] for c in children])
        d = self._distance(routers, routers[0])
        radius = max(float(x) + self.pages[c][1] for x, c in zip(d, children))
        self.pages.append((int(routers[0]), radius, np.array(children), d))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), best first, without the query's own id."""
        norm = float((query.astype(np.float64) ** 2).sum()) + self.most
        slack = 1e-6 * (1 + norm)
        far = lambda s: np.sqrt(np.maximum(0.0, norm - 2.0 * s))
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst comes first

        def reach() -> float:
            return float(np.sqrt(max(0.0, norm - 2.0 * best[0][0]) + slack)) if len(best) == k else float("inf")

        def routed(pages: np.ndarray) -> np.ndarray:
            return far(inner(query[None], self.vecs[[self.pages[p][0] for p in pages]])[0])

        heap: list[tuple[float, int, float]] = []

        def offer(pages: np.ndarray) -> None:
            for p, d in zip(pages, routed(pages)):
                bound = max(0.0, float(d) - self.pages[p][1])
                if bound <= reach():
                    heapq.heappush(heap, (bound, int(p), float(d)))

        if len(self.ids):
            offer(np.array(self.top))
        while heap:
            bound, p, d = heapq.heappop(heap)
            if bound > reach():
                break
            _, _, entries, to_parent = self.pages[p]
            near = reach()
            if p >= self.leaves:
                radius = np.array([self.pages[c][1] for c in entries])
                entries = entries[np.abs(d - to_parent) - radius <= near + 1e-6]
                if len(entries):
                    offer(entries)
                continue
            entries = entries[np.abs(d - to_parent) <= near + 1e-6]
            if not len(entries):
                continue
            scores = inner(query[None], self.vecs[entries])[0]
            floor = best[0][0] if len(best) == k else None
            for i in np.flatnonzero(scores >= floor) if floor is not None else range(len(scores)):
                vid = int(self.ids[entries[i]])
                if vid == own:
                    continue
                item = (int(scores[i]), -vid)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each usable row whose id is divisible by ``every``.

    Vectors of different lengths are not comparable and meet only those of their own length. Rows that repeat an id
    count as one candidate each, but a query never meets rows of its own id; queries that repeat an id with the same
    vector are asked once. Ties go to the smaller id.
    """
    rows = usable(vectors).withColumn("dim", F.size("vec"))
    norm = F.aggregate("vec", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, most = rows.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, asked = max(1, -(-n // shard)), rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "vec"])
    blocks = max(1, -(-asked.count() // block))
    # a vector meets the queries in every block, a query the vectors in every shard; both are dealt by hash, so neither has a hot group
    stored = rows.withColumn("shard", F.pmod(F.hash("vec_id", F.lit(1)), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.hash("vec_id", F.lit(2)), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    key, bound = ["dim", "shard", "block"], int(most)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = MTree(left["vec_id"].to_numpy(), np.array(left["vec"].tolist(), np.int64).reshape(len(left), -1), bound)
            for own, vec in zip(right["vec_id"], right["vec"]):
                out += [(own, v, s) for s, v in tree.search(np.asarray(vec, np.int64), own, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = stored.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
