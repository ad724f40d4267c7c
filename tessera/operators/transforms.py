"""Vector transforms: trained on aggregates, applied as projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators.models import matrix


def l2_normalise(vec: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(distances.norm2(vec))
    return F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)).otherwise(vec.cast("array<double>"))


def remap(vec: Column, places: list[int]) -> Column:
    """Component places[i] at i, 0 where that is negative."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda i: F.when(i < 0, 0.0).otherwise(F.get(vec, i).cast("double")))


def remap_places(d_in: int, d_out: int, uniform: bool = False) -> list[int]:
    if uniform:
        return [i * d_in // d_out for i in range(d_out)] if d_in >= d_out else [int(np.ceil(i * d_in / d_out)) if int(np.ceil(i * d_in / d_out)) < np.ceil((i + 1) * d_in / d_out) else -1 for i in range(d_out)]
    return [i if i < d_in else -1 for i in range(d_out)]


def means(vectors: DataFrame) -> DataFrame:
    """(pos, mean) of each component."""
    return vectors.select(F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def centred(vectors: DataFrame) -> DataFrame:
    m = means(vectors).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("m"))  # one row of d numbers
    return vectors.crossJoin(F.broadcast(m)).select("id", F.zip_with("vec", "m", lambda x, c: x.cast("double") - c).alias("vec"))


def minmax_rows(vec: Column) -> Column:
    """Each row scaled to 0..1 by its own extremes."""
    lo, hi = F.array_min(vec).cast("double"), F.array_max(vec).cast("double")
    return F.when(hi > lo, F.transform(vec, lambda x: (x.cast("double") - lo) / (hi - lo))).otherwise(F.transform(vec, lambda x: F.lit(0.0)))


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) from partial sums: one model-sized row from each task, folded in 64 groups."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf.vec)
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    parts = vectors.select("vec").mapInPandas(run, "n long, s array<double>, g array<double>")
    add = lambda c: F.reduce(F.slice(F.collect_list(c), 2, 1 << 30), F.first(c), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    rows = parts.groupBy(F.spark_partition_id() % 64).agg(F.sum("n").alias("n"), add("s").alias("s"), add("g").alias("g")).collect()
    n = sum(r.n for r in rows)
    s, g = sum(np.array(r.s) for r in rows), sum(np.array(r.g) for r in rows)
    mean = s / n
    return n, mean, g.reshape(len(s), -1) / n - np.outer(mean, mean)


def pca(vectors: DataFrame, d_out: int, eigen_power: float = 0.0, eps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(A, b) with x -> A x + b: leading eigenvectors, scaled by eigenvalue ** eigen_power (-0.5 whitens)."""
    _, mean, cov = moments(vectors)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[:d_out]
    a = v[:, order].T * ((w[order] + eps) ** eigen_power if eigen_power else np.ones(len(order)))[:, None]
    return a, -a @ mean


def random_rotation(d_out: int, d_in: int, seed: int = 1234) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d_in, d_out),) * 2))
    return q[:d_out, :d_in]


def apply_linear(vectors: DataFrame, a: np.ndarray, b: np.ndarray | None = None) -> DataFrame:
    """x -> A x + b, as one matrix product for each Arrow batch."""
    shared = vectors.sparkSession.sparkContext.broadcast((a, 0.0 if b is None else b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m, off = shared.value
                yield pd.DataFrame({"id": pdf.id, "vec": list(matrix(pdf.vec) @ m.T + off)})

    return vectors.select("id", "vec").mapInPandas(run, "id long, vec array<double>")


def reverse_linear(vectors: DataFrame, a: np.ndarray, b: np.ndarray | None = None) -> DataFrame:
    """Inverse of an orthonormal (transpose) or any full-rank map (pseudo-inverse)."""
    inverse = a.T if np.allclose(a @ a.T, np.eye(len(a)), atol=1e-6) else np.linalg.pinv(a)
    return apply_linear(vectors, inverse, None if b is None else -inverse @ b)


def itq(x: np.ndarray, n_iter: int = 30, seed: int = 1234) -> np.ndarray:
    """Rotation of a bounded sample that brings it near the corners of the cube."""
    r = random_rotation(x.shape[1], x.shape[1], seed)
    for _ in range(n_iter):
        u, _, vt = np.linalg.svd(np.sign(x @ r.T).T @ x)
        r = u @ vt
    return r


def opq(x: np.ndarray, m: int, codes: int, n_iter: int = 10, seed: int = 1234) -> tuple[np.ndarray, list[float]]:
    """(rotation, error after each iteration) of a bounded sample: product quantizer and rotation in turn."""
    from tessera.operators.quantizers import models

    r, errors, rng = random_rotation(x.shape[1], x.shape[1], seed), [], np.random.default_rng(seed)
    books = None
    for _ in range(n_iter):
        y = (x @ r.T).reshape(len(x), m, -1)
        if books is None:
            books = y[rng.permutation(len(x))[:codes]].transpose(1, 0, 2).copy()
        out = np.empty_like(y)
        for i in range(m):
            for _ in range(4):
                near = models.squared_distances(y[:, i], books[i]).argmin(axis=1)
                n = np.bincount(near, minlength=codes)
                sums = np.zeros_like(books[i])
                np.add.at(sums, near, y[:, i])
                books[i] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], books[i])
            out[:, i] = books[i][models.squared_distances(y[:, i], books[i]).argmin(axis=1)]
        errors.append(float(((y - out) ** 2).sum()))
        u, _, vt = np.linalg.svd(out.reshape(len(x), -1).T @ x)
        r = u @ vt
    return r, errors
