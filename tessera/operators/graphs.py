"""Proximity graphs: NN-descent by self-joins, and navigable graphs inside shards."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators import knn, models
from tessera.operators.lineage import cut


def nn_descent(vectors: DataFrame, k: int, rounds: int = 4, sample: int = 16, seed: int = 1, pool: int = 16) -> DataFrame:
    """(src, dst, dis): approximate k-NN graph. Neighbours of neighbours become candidates, round by round.

    ``pool`` neighbours are kept on the way. Each round joins at most ``sample`` edges a node with as many of its neighbours, so no node's degree squares.
    """
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    slots = F.greatest(F.lit(1), F.lit(v.count() // (pool // 2)))
    start = v.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64("id", F.lit(seed + i)), slots).alias("h")) for i in range(3)])).alias("slot"))  # three random groupings overlap
    first = start.select(F.col("id").alias("src"), "slot").join(start.select(F.col("id").alias("dst"), "slot"), "slot").where("src <> dst").select("src", "dst").distinct()
    pool = max(pool, k)
    edges = cut(_best(_with_distance(first, v), pool))
    for _ in range(rounds):
        w = Window.partitionBy("a").orderBy("dis", "b")
        both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "dis").union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "dis")).distinct()
        near = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample).select("a", "b")
        steps = near.select("a", F.col("b").alias("src")).join(near.select("a", F.col("b").alias("dst")), "a").where("src <> dst").select("src", "dst")
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        fresh = _with_distance(steps.union(back).distinct(), v)
        edges = cut(_best(edges.union(fresh.select("src", "dst", "dis")).distinct(), pool))
    return _best(edges, k)


def _with_distance(pairs: DataFrame, v: DataFrame) -> DataFrame:
    p = pairs.join(v.select(F.col("id").alias("src"), F.col("vec").alias("x")), "src").join(v.select(F.col("id").alias("dst"), F.col("vec").alias("y")), "dst")
    return p.select("src", "dst", distances.l2(F.col("x"), F.col("y")).alias("dis"))


def _best(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dis", "dst")
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("src", "dst", "dis")


class Navigable:
    """A layered small-world graph over one shard, searched best first."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 40, seed: int = 1):
        self.x, self.m, self.ef = x, m, ef
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(len(x))) / np.log(m)).astype(int), 8)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(9)]
        self.entry = None
        for i in range(len(x)):
            self._add(i)

    def _walk(self, q, start, level, ef):
        d = lambda i: float(((self.x[i] - q) ** 2).sum())
        seen = {start}
        todo = [(d(start), start)]
        best = [(-todo[0][0], start)]
        while todo:
            dist, i = heapq.heappop(todo)
            if dist > -best[0][0] and len(best) >= ef:
                break
            near = [j for j in self.links[level].get(i, ()) if j not in seen]
            seen.update(near)
            if near:
                for dj, j in zip(((self.x[near] - q) ** 2).sum(axis=1).tolist(), near):
                    if len(best) < ef or dj < -best[0][0]:
                        heapq.heappush(todo, (dj, j))
                        heapq.heappush(best, (-dj, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-a, i) for a, i in best)

    def _add(self, i):
        if self.entry is None:
            self.entry = i
            for level in range(self.level[i] + 1):
                self.links[level][i] = []
            return
        at, top = self.entry, int(self.level[self.entry])
        for level in range(top, self.level[i], -1):
            at = self._walk(self.x[i], at, level, 1)[0][1]
        for level in range(min(top, int(self.level[i])), -1, -1):
            found = self._walk(self.x[i], at, level, self.ef)
            most = self.m * 2 if level == 0 else self.m
            self.links[level][i] = [j for _, j in found[: self.m]]
            for _, j in found[: self.m]:
                own = self.links[level].setdefault(j, [])
                own.append(i)
                if len(own) > most:
                    own.sort(key=lambda t, j=j: float(((self.x[t] - self.x[j]) ** 2).sum()))
                    del own[most:]
            at = found[0][1]
        for level in range(top + 1, self.level[i] + 1):
            self.links[level][i] = []
        if self.level[i] > top:
            self.entry = i

    def search(self, q, k, ef=16):
        at = self.entry
        for level in range(int(self.level[self.entry]), 0, -1):
            at = self._walk(q, at, level, 1)[0][1]
        return self._walk(q, at, 0, max(ef, k))[:k]


def sharded_graph_search(queries: DataFrame, vectors: DataFrame, k: int, shards: int = 4, m: int = 16, ef: int = 64) -> DataFrame:
    """(qid, rank, id, dis): a navigable graph in every shard, results merged by rank."""
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    x = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"))

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(qs):
            xs = xs.sort_values("id")
            ids, g = xs.id.to_numpy(), Navigable(models.matrix(xs.vec), m)
            out = [(qid, ids[i], d) for qid, v in zip(qs.qid, models.matrix(qs.qvec)) for d, i in g.search(v, k, ef)]
        return pd.DataFrame(out, columns=["qid", "id", "dis"])

    found = q.groupBy("s").cogroup(x.groupBy("s")).applyInPandas(run, "qid long, id long, dis double")
    return knn.top_k(found, k).select("qid", "rank", "id", "dis")
