"""Small trained models (centroids, codebooks) as arrays: pinned samples, k-means, assignment.

A model is bounded by its own parameters (lists, codes, dimensions), never by the data, so it is
kept on the driver and broadcast. Data stay distributed: each round of training is one
aggregation over partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import Files, cut

#: A training sample of at most so many values (rows times dimensions) and so many products (values times centroids)
#: a round is trained on the driver; a larger one by one distributed aggregation a round.
LOCAL_VALUES, LOCAL_PRODUCTS = 1 << 21, 1 << 28


def sample_order(seed: int, key: str = "id") -> Column:
    """An order of rows that any engine can compute."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample(vectors: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """The first n rows in sample order."""
    return vectors.orderBy(sample_order(seed), "id").limit(n)


def pinned_centroids(vectors: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    rows = sample(vectors, n, seed).select("vec").collect()
    return np.array([r.vec for r in rows], dtype=np.float64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared L2 distances, a few rows at a time, by differences (no cancellation)."""
    out = np.empty((len(x), len(c)))
    for i in range(0, len(x), 256):
        d = x[i : i + 256, None, :] - c[None]
        out[i : i + 256] = np.einsum("ijk,ijk->ij", d, d)
    return out


def nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of each row's k nearest centroids, ties to the smaller number.

    Matrix products choose: all centroids within their rounding error of the k-th. Differences decide, as ``squared_distances`` has them.
    """
    k, wide = min(k, len(c)), np.isfinite(c).all()
    near, dis = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    norms = (c * c).sum(1)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        own = (part * part).sum(1)
        with np.errstate(invalid="ignore", over="ignore"):
            d = own[:, None] + norms[None] - 2 * (part @ c.T)
            most = np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-12 * (own + norms.max() + 1.0) * x.shape[1]
            some = d <= most[:, None]
        plain = (some.sum(1) == k) & np.isfinite(most) & wide
        at = np.flatnonzero(plain)
        if len(at):
            chosen = np.nonzero(some[at])[1].reshape(-1, k)
            diff = part[at, None, :] - c[chosen]
            exact = np.einsum("ijk,ijk->ij", diff, diff)
            order = np.argsort(exact, axis=1, kind="stable")
            near[i + at], dis[i + at] = np.take_along_axis(chosen, order, 1), np.take_along_axis(exact, order, 1)
        at = np.flatnonzero(~plain)
        if len(at):
            exact = squared_distances(part[at], c)
            order = np.argsort(exact, axis=1, kind="stable")[:, :k]
            near[i + at], dis[i + at] = order, np.take_along_axis(exact, order, 1)
    return near, dis


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def assign(vectors: DataFrame, centroids: np.ndarray, k: int = 1) -> DataFrame:
    """(id, vec, rank, list_no, dis): each vector's k nearest centroids by squared L2, ties to the smaller number."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            near, dis = nearest(matrix(pdf.vec), shared.value, k)
            n = near.shape[1]
            yield pd.DataFrame({
                "id": np.repeat(pdf.id.to_numpy(), n), "vec": np.repeat(pdf.vec.to_numpy(), n), "rank": np.tile(np.arange(1, n + 1), len(pdf)),
                "list_no": near.ravel(), "dis": dis.ravel(),
            })

    return vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, "id long, vec array<double>, rank int, list_no int, dis double")


def centroid_update(assigned: DataFrame, weight: str | None = None) -> DataFrame:
    """(list_no, size, vec): (weighted) mean of each list, by one map-side combined aggregation."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = assigned.select("list_no", w.alias("w"), F.posexplode("vec").alias("pos", "x"))
    sums = parts.groupBy("list_no", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), F.count("*").alias("size"))
    return sums.groupBy("list_no").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vec"))


def _sums(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums and sizes of each centroid's points, and the points' summed squared distance."""
    near, dis = (v[:, 0] for v in nearest(x, c))
    sums = np.zeros_like(c)
    np.add.at(sums, near, x * w[:, None])
    return sums, np.bincount(near, w, len(c)), float((dis * w).sum())


def _partial_sums(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        sums, counts, cost = np.zeros_like(c), np.zeros(len(c)), 0.0
        for pdf in batches:
            if len(pdf):
                more = _sums(matrix(pdf.vec), pdf.w.to_numpy(float), c)
                sums, counts, cost = sums + more[0], counts + more[1], cost + more[2]
        yield pd.DataFrame({"sums": [sums.ravel()], "counts": [counts], "cost": [cost]})

    return run


def _distributed_sums(data: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    shared = data.sparkSession.sparkContext.broadcast(c)
    parts = data.mapInPandas(_partial_sums(shared), "sums array<double>, counts array<double>, cost double")
    fold = lambda f, m: F.reduce(F.collect_list(f), F.array_repeat(F.lit(0.0), m), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias(f)
    rows = parts.groupBy(F.spark_partition_id() % 64).agg(fold("sums", c.size), fold("counts", len(c)), F.sum("cost").alias("cost")).collect()  # at most 64 model-sized rows
    return sum(np.array(r.sums) for r in rows).reshape(c.shape), sum(np.array(r.counts) for r in rows), sum(r.cost for r in rows)


def _moved(c: np.ndarray, sums: np.ndarray, counts: np.ndarray, rng: np.random.Generator, spherical: bool, whole: bool) -> tuple[np.ndarray, int]:
    """(new centroids, splits)."""
    c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1e-300)[:, None], c)
    splits = split_empty(c, counts, rng)
    if spherical:
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return (np.rint(c) if whole else c), splits


def _first(ids: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of the first n ids in sample order."""
    return np.array(sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{ids[i]}:{seed}".encode()).hexdigest(), ids[i]))[:n])


def _local_kmeans(x: np.ndarray, ids: np.ndarray, k: int, n_iter: int, seed: int) -> np.ndarray:
    c = x[_first(ids, k, seed)]
    for it in range(n_iter):
        sums, counts, _ = _sums(x, np.ones(len(x)), c)
        c, _ = _moved(c, sums, counts, np.random.default_rng((seed, it)), False, False)
    return c


def split_empty(c: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> int:
    """Empty clusters take half of a large one, drawn by size, moved apart by 1/1024."""
    empty = np.flatnonzero(counts == 0)
    for i in empty:
        p = np.maximum(counts - 1, 0)
        j = int(rng.choice(len(counts), p=p / p.sum())) if p.sum() > 0 else int(counts.argmax())
        up = np.where(np.arange(c.shape[1]) % 2 == 0, 1 + 1 / 1024, 1 - 1 / 1024)
        c[i], c[j] = c[j] * up, c[j] * (2 - up)
        counts[i] = counts[j] = counts[j] / 2
    return len(empty)


def imbalance(counts: np.ndarray) -> float:
    return float(len(counts) * (counts**2).sum() / max(counts.sum(), 1e-300) ** 2)


def kmeans(vectors: DataFrame, k: int, n_iter: int = 25, n_redo: int = 1, seed: int = 1234, spherical: bool = False, whole: bool = False, frozen: bool = False,
           weight: str | None = None, start: np.ndarray | None = None, max_points: int | None = 256, resume: str | None = None) -> tuple[np.ndarray, list[dict]]:
    """Lloyd's k-means: (centroids, statistics of each iteration).

    Trains on at most ``max_points * k`` rows in sample order, as many as a clustering needs; None: on all rows. Errors: fewer rows
    than k; NaN or infinite components. ``whole`` rounds centroids, ``spherical`` puts them on
    the unit sphere, ``frozen`` only reports the starting centroids. ``resume``: a folder in which each iteration's
    centroids are written; a training that was broken off goes on from the last one (with one run, ``n_redo`` 1).
    """
    if resume and n_redo > 1:
        raise ValueError("a training in several runs cannot be resumed")
    w = F.col(weight) if weight else F.lit(1.0)
    data = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), w.cast("double").alias("w"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n, n_bad, d = data.agg(F.count("*"), F.sum(bad.cast("int")), F.max(F.size("vec"))).first()
    if n < k:
        raise ValueError(f"{n} points for {k} clusters")
    if n_bad:
        raise ValueError("points hold NaN or infinite values")
    n_used = n if max_points is None else min(n, max_points * k)
    if n > n_used:
        data = sample(data, n_used, seed)
    local = n_used * d <= LOCAL_VALUES and n_used * d * k <= LOCAL_PRODUCTS
    if local:
        rows = data.collect()  # at most LOCAL_VALUES numbers
        ids, x, ws = [r.id for r in rows], np.array([r.vec for r in rows], dtype=np.float64), np.array([r.w for r in rows])
    else:  # a sample comes as one part
        data = (data.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id") if n > n_used else data).persist()
    best = None
    try:
        for redo in range(n_redo):
            c = start.astype(np.float64).copy() if start is not None else x[_first(ids, k, seed + redo)] if local else pinned_centroids(data, k, seed + redo)
            stats, done = [], -1
            if resume:
                files = Files(vectors.sparkSession, resume)
                done = max((int(f[6:]) for f in files.names() if f.startswith("round=") and files.exists(f"{f}/_SUCCESS")), default=-1)
                if done >= 0:
                    held = vectors.sparkSession.read.parquet(f"{resume}/round={done}").orderBy("list_no").collect()  # k rows
                    c = np.array([r.vec for r in held])
            for it in range(done + 1, 0 if frozen else n_iter):
                sums, counts, cost = _sums(x, ws, c) if local else _distributed_sums(data, c)
                stat = {"iteration": it, "objective": cost, "imbalance": imbalance(counts)}
                c, splits = _moved(c, sums, counts, np.random.default_rng((seed + redo, it)), spherical, whole)
                stats.append(stat | {"splits": splits})
                if resume:
                    vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list_no int, vec array<double>").write.mode("overwrite").parquet(f"{resume}/round={it}")
            if best is None or (stats and stats[-1]["objective"] < best[1][-1]["objective"]):
                best = (c, stats)
    finally:
        data.unpersist()
    return best


def progressive_kmeans(vectors: DataFrame, k: int, rotation: np.ndarray, steps: int = 4, n_iter: int = 5, seed: int = 1234) -> np.ndarray:
    """k centroids, trained over ever more leading dimensions of the rotated vectors, each step from the last one's.

    ``rotation`` is an orthonormal (d, d) matrix whose leading rows carry most variance (``transforms.pca``). Widths grow
    geometrically from 1 to d; new dimensions start at 0. The centroids are returned in the vectors' own space.
    """
    d = len(rotation)
    rotate = _rotated(vectors.sparkSession.sparkContext.broadcast(rotation))
    turned = cut(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(rotate, "id long, vec array<double>"))
    c = np.zeros((k, 0))
    for width in sorted({max(1, round(d ** (i / steps))) for i in range(1, steps + 1)}):
        part = turned.select("id", F.slice("vec", 1, width).alias("vec"))
        start = np.hstack([c, np.zeros((k, width - c.shape[1]))]) if c.shape[1] else None
        c, _ = kmeans(part, k, n_iter, seed=seed, start=start)
    return c @ rotation


def _rotated(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "vec": list(matrix(pdf.vec) @ shared.value.T)})

    return run


def exact_kmeans_1d(values: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Optimal one-dimensional k-means over distinct values' multiset (dynamic programme, divide and conquer)."""
    x = np.sort(np.asarray(values, dtype=np.float64))
    n = len(x)
    k = min(k, n)
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1)
    best = cost(np.zeros(n + 1, int), np.arange(n + 1))
    back = []
    for _ in range(1, k):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        work = [(1, n, 0, n)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            c = best[i] + cost(i, np.full(len(i), mid))
            j = int(c.argmin())
            nxt[mid], cut[mid] = c[j], i[j]
            work += [(lo, mid - 1, a, int(i[j])), (mid + 1, hi, int(i[j]), b)]
        best, back = nxt, [*back, cut]
    edges, j = [n], n
    for cut in reversed(back):
        j = int(cut[j])
        edges.append(j)
    edges = [0, *sorted(set(edges) - {0})]
    return np.array([(s[b] - s[a]) / (b - a) for a, b in zip(edges[:-1], edges[1:])]), float(max(best[n], 0.0))


def two_level_kmeans(vectors: DataFrame, k1: int, k: int, n_iter: int = 10, seed: int = 1234, max_points: int = 256) -> np.ndarray:
    """k centroids: k1 clusters first, each then split into its share of k by size (cumulative rounding).

    All clusters are split in one grouped pass; a task holds ``max_points`` rows a centroid of its cluster, in sample order.
    """
    coarse, _ = kmeans(vectors, k1, n_iter, seed=seed)
    placed = assign(vectors, coarse).select("list_no", "id", "vec")
    sizes = np.zeros(k1)
    for r in placed.groupBy("list_no").count().collect():
        sizes[r.list_no] = r["count"]
    ends = np.rint(np.cumsum(sizes) / sizes.sum() * k).astype(int)
    share = np.minimum(np.diff(np.concatenate([[0], ends])), sizes).astype(int)
    held = placed.withColumn("r", F.row_number().over(Window.partitionBy("list_no").orderBy(sample_order(seed), "id"))).where(F.col("r") <= max_points * int(share.max()))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(share[key[0]])
        pdf = pdf[pdf.r <= max_points * m]
        c = _local_kmeans(matrix(pdf.vec), pdf.id.to_numpy(), m, n_iter, seed) if m > 1 else coarse[key[0] : key[0] + m]
        return pd.DataFrame({"list_no": key[0], "place": np.arange(len(c)), "vec": list(c)})

    rows = held.groupBy("list_no").applyInPandas(run, "list_no int, place long, vec array<double>").collect()  # k rows at most
    return np.array([r.vec for r in sorted(rows, key=lambda r: (r.list_no, r.place))])
