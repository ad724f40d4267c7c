"""Codecs: product, scalar, additive and lattice quantizers as encode / decode projections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product as cross

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.operators import knn, models


# Product quantizer: a codebook is an array (m, codes, sub-dimensions).


def pinned_codebook(vectors: DataFrame, m: int, codes: int, seed: int = 1) -> np.ndarray:
    c = models.pinned_centroids(vectors, codes, seed)
    return c.reshape(len(c), m, -1).transpose(1, 0, 2)


def train_pq(vectors: DataFrame, m: int, codes: int, n_iter: int = 25, seed: int = 1234, shared: bool = False, start: np.ndarray | None = None) -> np.ndarray:
    """A k-means for each of m sub-spaces; ``shared``: one codebook for all; ``start``: hot start."""
    vec = F.col("vec").cast("array<double>")
    d = len(vectors.select("vec").first().vec)
    sub = d // m
    part = lambda i: vectors.select("id", F.slice(vec, i * sub + 1, sub).alias("vec"))
    if shared:
        rows = vectors.select("id", F.explode(F.array(*[F.slice(vec, i * sub + 1, sub) for i in range(m)])).alias("vec"))
        return np.repeat(models.kmeans(rows, codes, n_iter, seed=seed)[0][None], m, axis=0)
    return np.stack([models.kmeans(part(i), codes, n_iter, seed=seed, start=None if start is None else start[i])[0] for i in range(m)])


def pq_codes(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Each row's nearest entry of each sub-space, the first of equal ones."""
    m, _, sub = codebook.shape
    x = x.reshape(len(x), m, sub)
    return np.stack([models.squared_distances(x[:, i], codebook[i]).argmin(axis=1) for i in range(m)], axis=1).astype(np.int32)


def encode_pq(vectors: DataFrame, codebook: np.ndarray, *keep: str) -> DataFrame:
    """Adds code (array<int>): the nearest entry of each sub-space, the first of equal ones."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(code=list(pq_codes(models.matrix(pdf.vec), shared.value)))

    src = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), *keep)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInPandas(run, f"{fields}, code array<int>")


def _literal(values: np.ndarray) -> Column:
    return F.array(*[_literal(v) if np.ndim(v) else F.lit(float(v)) for v in values])


def decode_pq(code: Column, codebook: np.ndarray) -> Column:
    """Concatenated entries. The codebook becomes a literal, so keep it small (thousands of numbers)."""
    books = _literal(codebook)
    return F.flatten(F.transform(code, lambda c, i: F.get(F.get(books, i), c)))


def tables(queries: DataFrame, codebook: np.ndarray, metric: str = "l2") -> DataFrame:
    """(qid, lut): each query's distance to every entry of every sub-space."""
    shared = queries.sparkSession.sparkContext.broadcast(codebook)
    m, _, sub = codebook.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = models.matrix(pdf.vec).reshape(len(pdf), m, sub)
                lut = [[(models.squared_distances(v[i : i + 1], shared.value[i])[0] if metric == "l2" else shared.value[i] @ v[i]).tolist() for i in range(m)] for v in x]
                yield pd.DataFrame({"qid": pdf.id, "lut": lut})

    return queries.select("id", "vec").mapInPandas(run, "qid long, lut array<array<double>>")


def adc(lut: Column, code: Column) -> Column:
    """Sum over sub-spaces of the table's entry for the code."""
    return F.aggregate(F.zip_with(lut, code, lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, v: s + v)


#: Columns of a search of code lists.
FOUND = ["qid", "id", "q2c", "o2c", "dis"]
FOUND_SCHEMA = "qid long, id long, q2c double, o2c double, dis double"


def _best_codes(qids, v, q2c, ids, codes, o2c, book, k: int, zone: int) -> list[np.ndarray]:
    """Columns as ``FOUND``: each query's k nearest of one list's entries; ``v`` holds the queries by sub-space."""
    out = [[] for _ in FOUND]
    for at in range(0, len(v), 32):  # bounded memory, however many queries
        all_ = np.zeros((len(v[at : at + 32]), len(ids)))
        for i in range(len(book)):
            all_ += models.squared_distances(v[at : at + 32, i], book[i])[:, codes[:, i]]
        own, far = qids[at : at + 32], q2c[at : at + 32]
        good = (np.abs(ids[None] - own[:, None]) > zone) & ~np.isnan(all_)
        if len(ids) > k:
            good &= all_ <= np.partition(np.where(good, all_, np.inf), k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(good)
        order = np.lexsort((ids[col], all_[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        for name, value in zip(out, (own[row], ids[col], far[row], o2c[col], all_[row, col])):
            name.append(value)
    return [np.concatenate(x) for x in out]


def nearest_codes(probed: DataFrame, lists: DataFrame, codebook: np.ndarray, k: int, zone: int = -1) -> DataFrame:
    """(qid, id, q2c, o2c, dis): each query's k entries of its probed lists nearest by tables, ties to the smaller id.

    ``probed`` holds (qid, qvec, list_no, q2c), ``lists`` (list_no, id, code, o2c); only ids further than ``zone`` from
    the query's take part. A task makes the tables of the queries that probe its part of a list, gathers their sums and
    sends k rows a query on. Long lists are cut into parts of about ``knn.SHARD_ROWS`` rows; no table crosses the network.
    """
    shared = lists.sparkSession.sparkContext.broadcast(codebook)
    m, _, sub = codebook.shape
    sizes = lists.groupBy("list_no").agg(F.ceil(F.count("*") / knn.SHARD_ROWS).cast("int").alias("parts"))
    held = lists.join(sizes, "list_no").select("list_no", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "code", "o2c")
    asked = probed.join(sizes, "list_no").select("list_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "qvec", "q2c")

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({n: [] for n in FOUND})
        v = models.matrix(qs.qvec).reshape(len(qs), m, sub)
        best = _best_codes(qs.qid.to_numpy(), v, qs.q2c.to_numpy(), xs.id.to_numpy(), np.stack(xs.code.to_list()), xs.o2c.to_numpy(), shared.value, k, zone)
        return pd.DataFrame(dict(zip(FOUND, best)))

    found = asked.groupBy("list_no", "part").cogroup(held.groupBy("list_no", "part")).applyInPandas(run, FOUND_SCHEMA)
    return knn.top_k(found, k).drop("rank")


def nearest_codes_of(qids: np.ndarray, x: np.ndarray, probed: np.ndarray, q2c: np.ndarray, lists: DataFrame, codebook: np.ndarray, k: int, zone: int = -1) -> DataFrame:
    """As ``nearest_codes``, for queries that the driver holds: row i of ``probed`` and ``q2c`` are the lists that query i visits.

    The queries are broadcast and the lists stay where they are: a task searches its own rows of every list, about
    ``knn.SHARD_ROWS`` at a time, and sends k rows a query on for each such lot.
    """
    order = np.argsort(probed, axis=None, kind="stable")
    shared = lists.sparkSession.sparkContext.broadcast((qids, x.reshape(len(x), *codebook.shape[::2]), probed.ravel()[order], order // probed.shape[1], q2c.ravel()[order], codebook))
    lot = knn.SHARD_ROWS

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        qids, v, asked, query, q2c, book = shared.value
        t = pa.Table.from_batches(held)
        number, ids, o2c = (t[c].to_numpy() for c in ("list_no", "id", "o2c"))
        codes = t["code"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(number, kind="stable")
        lists, begin = np.unique(number[order], return_index=True)
        first, last = np.searchsorted(asked, lists), np.searchsorted(asked, lists, "right")
        found = []
        for a, b, lo, hi in zip(begin, [*begin[1:], len(order)], first, last):
            if hi > lo:
                q, at = query[lo:hi], order[a:b]
                found.append(_best_codes(qids[q], v[q], q2c[lo:hi], ids[at], codes[at], o2c[at], book, k, zone))
        best = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, float, float, float)]
        order = np.lexsort((best[1], best[4], best[0]))
        own = best[0][order]
        order = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
        return pa.RecordBatch.from_arrays([pa.array(c[order]) for c in best], FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= lot:
                yield search(held)
                held, n = [], 0
        if n:
            yield search(held)

    found = lists.select("list_no", "id", "code", "o2c").mapInArrow(run, FOUND_SCHEMA)
    return knn.top_k(found, k).drop("rank")


def search_pq(queries: DataFrame, codes: DataFrame, codebook: np.ndarray, k: int, metric: str = "l2", most_bits: int | None = None) -> DataFrame:
    """k-NN by asymmetric distances to codes (id, code); ``most_bits``: a polysemous filter on differing code bits."""
    t = tables(queries, codebook, metric)
    if most_bits is not None:
        own = encode_pq(queries, codebook).select(F.col("id").alias("qid"), F.col("code").alias("qcode"))
        t = t.join(own, "qid")
    pairs = knn.beside(codes.select("id", "code"), t, queries, codebook.shape[0] * codebook.shape[1] * 8)
    if most_bits is not None:
        differ = F.aggregate(F.zip_with("qcode", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
        pairs = pairs.where(differ < most_bits)
    return knn.top_k(pairs.select("qid", "id", adc(F.col("lut"), F.col("code")).alias("dis")), k, metric).select("qid", "rank", "id", "dis")


def symmetric_table(codebook: np.ndarray) -> np.ndarray:
    return np.stack([models.squared_distances(c, c) for c in codebook])


def search_sdc(queries: DataFrame, codes: DataFrame, codebook: np.ndarray, k: int) -> DataFrame:
    """k-NN by distances between codes: the query is encoded too."""
    table = symmetric_table(codebook)
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf.id, "lut": [[shared.value[i][c].tolist() for i, c in enumerate(code)] for code in pdf.code]})

    luts = encode_pq(queries, codebook).select("id", "code").mapInPandas(run, "qid long, lut array<array<double>>")
    pairs = knn.beside(codes.select("id", "code"), luts, queries, table[:, 0].size * 8)
    return knn.top_k(pairs.select("qid", "id", adc(F.col("lut"), F.col("code")).alias("dis")), k).select("qid", "rank", "id", "dis")


def rounded_tables(luts: DataFrame) -> DataFrame:
    """(qid, qlut, a, b): tables rounded to bytes with one scale; distance = sum / a + b."""
    low = F.transform("lut", lambda t: F.array_min(t))
    span = F.transform("lut", lambda t: F.array_max(t) - F.array_min(t))
    out = luts.withColumns({"low": low, "widest": F.array_max(span), "all": F.aggregate(span, F.lit(0.0), lambda s, v: s + v)})
    out = out.withColumn("a", F.when(F.col("widest") > 0, F.least(255.0 / F.col("widest"), 65535.0 / F.col("all"))).otherwise(F.lit(1.0)))
    q = F.zip_with("lut", "low", lambda t, m: F.transform(t, lambda v: F.floor((v - m) * F.col("a") + 0.5).cast("int")))
    return out.select("qid", q.alias("qlut"), "a", F.aggregate("low", F.lit(0.0), lambda s, v: s + v).alias("b"))


# Scalar quantizer: per-dimension (or uniform) ranges, code = floor(levels * clipped position).


def ranges(vectors: DataFrame, kind: str = "minmax", arg: float = 0.0, uniform: bool = False) -> DataFrame:
    """(pos, vmin, vdiff), or one row without pos where uniform. kinds: minmax, meanstd, quantiles."""
    parts = vectors.select(F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
    g = parts.groupBy() if uniform else parts.groupBy("pos")
    if kind == "minmax":
        t = g.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        grow = (F.col("hi") - F.col("lo")) * arg
        return t.select(*([] if uniform else ["pos"]), (F.col("lo") - grow).alias("vmin"), (F.col("hi") - F.col("lo") + 2 * grow).alias("vdiff"))
    if kind == "meanstd":
        t = g.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        return t.select(*([] if uniform else ["pos"]), (F.col("m") - arg * F.col("s")).alias("vmin"), (2 * arg * F.col("s")).alias("vdiff"))
    t = g.agg(F.percentile("x", arg).alias("lo"), F.percentile("x", 1 - arg).alias("hi"))
    return t.select(*([] if uniform else ["pos"]), F.col("lo").alias("vmin"), (F.col("hi") - F.col("lo")).alias("vdiff"))


def as_arrays(found: DataFrame, d: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    rows = found.orderBy("pos").collect() if "pos" in found.columns else found.collect() * (d or 1)  # one row for each dimension
    return np.array([r.vmin for r in rows]), np.array([r.vdiff for r in rows])


def encode_sq(vec: Column, vmin: np.ndarray, vdiff: np.ndarray, bits: int = 8) -> Column:
    lo, width, top = _literal(vmin), _literal(vdiff), float((1 << bits) - 1)
    at = lambda x, i: F.when(F.get(width, i) == 0.0, 0.0).otherwise((x - F.get(lo, i)) / F.when(F.get(width, i) != 0.0, F.get(width, i)))
    return F.transform(vec.cast("array<double>"), lambda x, i: F.floor(top * F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(x, i)))).cast("int"))


def decode_sq(code: Column, vmin: np.ndarray, vdiff: np.ndarray, bits: int = 8) -> Column:
    lo, width, top = _literal(vmin), _literal(vdiff), float((1 << bits) - 1)
    return F.transform(code, lambda c, i: F.get(lo, i) + F.get(width, i) * ((c.cast("double") + 0.5) / top))


@F.pandas_udf(ArrayType(DoubleType()))
def half_precision(vec: pd.Series) -> pd.Series:
    """Each component rounded to 16-bit floating point."""
    return vec.map(lambda v: np.asarray(v, dtype=np.float16).astype(np.float64))


# Additive quantizers: a codebook is an array (steps, codes, dimensions); a vector is the sum of its entries.


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the best beam, residuals of all beams): each step keeps the ``beam`` best of all extensions."""
    codes, rest = np.zeros((len(x), 1, 0), int), x[:, None, :]
    for c in books:
        d = models.squared_distances(rest.reshape(-1, x.shape[1]), c).reshape(len(x), -1)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(beam, d.shape[1])]
        old, new = near // len(c), near % len(c)
        codes = np.concatenate([np.take_along_axis(codes, old[:, :, None], 1), new[:, :, None]], axis=2)
        rest = np.take_along_axis(rest, old[:, :, None], 1) - c[new]
    return codes[:, 0], rest


def train_rq(x: np.ndarray, steps: int, codes: int, beam: int = 5, seed: int = 1, n_iter: int = 10, refits: int = 0) -> np.ndarray:
    """Residual quantizer on a bounded training sample; ``refits``: least-squares passes over all codebooks."""
    rng, books, rest = np.random.default_rng(seed), [], x[:, None, :]
    for _ in range(steps):
        flat = rest.reshape(-1, x.shape[1])
        c = flat[rng.permutation(len(flat))[:codes]].copy()
        for _ in range(n_iter):
            near = models.squared_distances(flat, c).argmin(axis=1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, flat)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            models.split_empty(c, n.astype(float), rng)
        books.append(c)
        rest = beam_encode(x, np.stack(books), beam)[1]
    out = np.stack(books)
    for _ in range(refits):
        out = fit_codebooks(x, beam_encode(x, out, beam)[0], out.shape[1])
    return out


def fit_codebooks(x: np.ndarray, codes: np.ndarray, k: int, ridge: float = 1e-4) -> np.ndarray:
    """Least-squares codebooks for given codes."""
    n, m = codes.shape
    b = np.zeros((n, m * k))
    b[np.arange(n)[:, None], codes + np.arange(m) * k] = 1
    return np.linalg.solve(b.T @ b + ridge * np.eye(m * k), b.T @ x).reshape(m, k, -1)


def icm_encode(x: np.ndarray, books: np.ndarray, codes: np.ndarray, rounds: int = 4, perturb: int = 2, seed: int = 1) -> np.ndarray:
    """Local search: perturb some codes, then coordinate descent; a code changes only for the better."""
    rng, m = np.random.default_rng(seed), len(books)
    err = lambda c: ((x - books[np.arange(m), c].sum(axis=1)) ** 2).sum(axis=1)
    best, least = codes.copy(), err(codes)
    for _ in range(rounds):
        c = best.copy()
        for _ in range(perturb):
            c[np.arange(len(x)), rng.integers(0, m, len(x))] = rng.integers(0, books.shape[1], len(x))
        for j in range(m):
            rest = x - (books[np.arange(m), c].sum(axis=1) - books[j, c[:, j]])
            c[:, j] = models.squared_distances(rest, books[j]).argmin(axis=1)
        e = err(c)
        better = e < least
        best[better], least[better] = c[better], e[better]
    return best


def train_lsq(x: np.ndarray, steps: int, codes: int, iters: int = 6, seed: int = 1) -> np.ndarray:
    """Local search quantizer: alternates codebook fits (with decaying noise) and ICM encoding."""
    rng = np.random.default_rng(seed)
    c = rng.integers(0, codes, (len(x), steps))
    for i in range(iters):
        books = fit_codebooks(x, c, codes)
        books = books + rng.normal(size=books.shape) * x.std(axis=0) * (1 - (i + 1) / iters) ** 2 * 0.1
        c = icm_encode(x, books, c, seed=seed + i)
    return fit_codebooks(x, c, codes)


def encode_additive(vectors: DataFrame, books: np.ndarray, beam: int = 5, local: bool = False) -> DataFrame:
    """(id, vec, code, norm): codes by beam search (``local``: then local search) and the decoded vector's squared norm."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, b = models.matrix(pdf.vec), shared.value
                c = beam_encode(x, b, beam)[0]
                c = icm_encode(x, b, c) if local else c
                y = b[np.arange(len(b)), c].sum(axis=1)
                yield pdf.assign(code=list(c.astype(np.int32)), norm=(y * y).sum(axis=1))

    return vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, "id long, vec array<double>, code array<int>, norm double")


def decode_additive(code: Column, books: np.ndarray) -> Column:
    b = _literal(books)
    zero = F.array_repeat(F.lit(0.0), books.shape[2])
    return F.aggregate(F.transform(code, lambda c, i: F.get(F.get(b, i), c)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def search_additive(queries: DataFrame, codes: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """L2 by tables: |q|^2 - 2 sum(<q, entry>) + norm."""
    shared = queries.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = models.matrix(pdf.vec)
                yield pd.DataFrame({"qid": pdf.id, "q2": (x * x).sum(axis=1), "lut": [(-2 * (shared.value @ v)).tolist() for v in x]})

    t = queries.select("id", "vec").mapInPandas(run, "qid long, q2 double, lut array<array<double>>")
    pairs = knn.beside(codes.select("id", "code", "norm"), t, queries, books.shape[0] * books.shape[1] * 8)
    dis = F.col("q2") + F.col("norm") + adc(F.col("lut"), F.col("code"))
    return knn.top_k(pairs.select("qid", "id", dis.alias("dis")), k).select("qid", "rank", "id", "dis")


# Lattice: integer vectors of one squared norm.


class Sphere:
    """Integer points of squared norm r2 in d dimensions, ranked; d and r2 are small."""

    def __init__(self, d: int, r2: int):
        side = range(-int(r2**0.5), int(r2**0.5) + 1)
        self.points = np.array([p for p in cross(side, repeat=d) if sum(v * v for v in p) == r2], dtype=np.int64)
        self.rank = {tuple(p): i for i, p in enumerate(self.points)}

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rank of the point with the largest inner product with each row."""
        return (x @ self.points.T).argmax(axis=1)

    def decode(self, code: np.ndarray) -> np.ndarray:
        return self.points[code]
