"""Distance expressions over array columns (two float arrays of one length).

Every builder takes two array columns and gives a double column. Sums run in
double, in element order, so SQL that folds the same way gives the same bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics where larger means nearer.
SIMILARITIES = frozenset({"ip", "jaccard"})


def _d(c: Column) -> Column:
    return c.cast("double")


def fold(x: Column, y: Column, term: Callable[[Column, Column], Column]) -> Column:
    """Sum over positions of ``term(x_i, y_i)``."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: term(_d(a), _d(b))), F.lit(0.0), lambda s, v: s + v)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NaN where bottom is 0 (no ANSI error)."""
    return F.when(bottom == 0.0, F.lit(float("nan"))).otherwise(top / bottom)


def l2(x: Column, y: Column) -> Column:
    return fold(x, y, lambda a, b: (a - b) * (a - b))


def ip(x: Column, y: Column) -> Column:
    return fold(x, y, lambda a, b: a * b)


def l1(x: Column, y: Column) -> Column:
    return fold(x, y, lambda a, b: F.abs(a - b))


def linf(x: Column, y: Column) -> Column:
    return F.coalesce(F.array_max(F.zip_with(x, y, lambda a, b: F.abs(_d(a) - _d(b)))), F.lit(0.0))


def lp(p: float) -> Callable[[Column, Column], Column]:
    return lambda x, y: fold(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p))))


def canberra(x: Column, y: Column) -> Column:
    return fold(x, y, lambda a, b: ratio(F.abs(a - b), F.abs(a) + F.abs(b)))


def braycurtis(x: Column, y: Column) -> Column:
    return ratio(fold(x, y, lambda a, b: F.abs(a - b)), fold(x, y, lambda a, b: F.abs(a + b)))


def jensenshannon(x: Column, y: Column) -> Column:
    half = lambda a, m: F.when(a == 0.0, 0.0).otherwise(-a * F.ln(m / a))
    return fold(x, y, lambda a, b: half(a, (a + b) / 2.0) + half(b, (a + b) / 2.0)) * 0.5


def jaccard(x: Column, y: Column) -> Column:
    return ratio(fold(x, y, F.least), fold(x, y, F.greatest))


def nan_euclidean(x: Column, y: Column) -> Column:
    there = lambda a, b: ~(F.isnan(a) | F.isnan(b))
    n = fold(x, y, lambda a, b: F.when(there(a, b), 1.0).otherwise(0.0))
    s = fold(x, y, lambda a, b: F.when(there(a, b), (a - b) * (a - b)).otherwise(0.0))
    return ratio(F.size(x).cast("double"), n) * s


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": l2, "ip": ip, "l1": l1, "linf": linf, "canberra": canberra, "braycurtis": braycurtis,
    "jensenshannon": jensenshannon, "jaccard": jaccard, "nan_euclidean": nan_euclidean,
}


def metric(name: str, arg: float | None = None) -> Callable[[Column, Column], Column]:
    return lp(2.0 if arg is None else arg) if name == "lp" else METRICS[name]


def norm2(x: Column) -> Column:
    return ip(x, x)


# The same distances between rows of two matrices, (queries, d) and (rows, d), as a matrix: sums in element order.

#: Rows of a tile: what a step works on stays in the processor's cache.
TILE = 1024


def _power(d: np.ndarray, p: float) -> np.ndarray:
    return d if p == 1 else d * d if p == 2 else d * d * d if p == 3 else d**p


def _js(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    logs = [np.log(np.where(v == 0.0, 1.0, v)) for v in (a, b)]  # of a component, not of a pair: short next to the middle's
    m = (a + b) / 2.0
    if (a == 0.0).any() and (b == 0.0).any():
        m[m == 0.0] = 1.0
    m = np.log(m)
    return a * (logs[0] - m) + b * (logs[1] - m)


def _there(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ~(np.isnan(a) | np.isnan(b))


#: Terms that are summed, and what is made of the sums and the number of components.
ARRAYS: dict[str, tuple[list[Callable], Callable]] = {
    "l2": ([lambda a, b: np.square(a - b)], lambda s, d: s),
    "ip": ([lambda a, b: a * b], lambda s, d: s),
    "l1": ([lambda a, b: np.abs(a - b)], lambda s, d: s),
    "canberra": ([lambda a, b: np.abs(a - b) / (np.abs(a) + np.abs(b))], lambda s, d: s),
    "braycurtis": ([lambda a, b: np.abs(a - b), lambda a, b: np.abs(a + b)], lambda s, t, d: np.where(t == 0.0, np.nan, s / t)),
    "jensenshannon": ([_js], lambda s, d: s * 0.5),
    "jaccard": ([np.minimum, np.maximum], lambda s, t, d: np.where(t == 0.0, np.nan, s / t)),
    "nan_euclidean": ([lambda a, b: np.where(_there(a, b), 1.0, 0.0), lambda a, b: np.where(_there(a, b), np.square(a - b), 0.0)], lambda n, s, d: np.where(n == 0.0, np.nan, d / n) * s),
    "lp": ([], lambda s, d: s),
}


def array_metric(name: str, arg: float | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    terms, end = ARRAYS[name]
    p = 2.0 if arg is None else arg
    terms = terms or [lambda a, b: _power(np.abs(a - b), p)]

    def measure(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(x)))
        columns = np.ascontiguousarray(q.T)[:, :, None]
        with np.errstate(all="ignore"):
            for i in range(0, len(x), TILE):
                tile = np.ascontiguousarray(x[i : i + TILE].T)
                sums = [np.zeros((len(q), tile.shape[1])) for _ in terms]
                for a, b in zip(columns, tile):
                    for s, term in zip(sums, terms):
                        s += term(a, b)
                out[:, i : i + TILE] = end(*sums, q.shape[1])
        return out

    return measure
