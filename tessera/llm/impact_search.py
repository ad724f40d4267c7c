"""Operator 9: exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors become integers. A task holds one shard of the vectors and one block of queries.
For each dimension the shard keeps its postings by value. A query reads postings in order
of falling impact (what a posting adds over the dimension's worst value), all dimensions
down to one threshold at a time, and adds impacts to accumulators. At each threshold an
upper bound of every vector's score follows from its accumulator and the dimensions in which
it was not met yet. Reading stops only when those bounds prove that few vectors can be
members; these are scored exactly. Shards' results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._session import prepare

QUERY_BLOCK, SHARD = 4096, 8192
#: Thresholds, as shares of a query's largest impact.
STEPS = (0.8, 0.65, 0.5, 0.42, 0.35, 0.2, 0.1)


#: Accumulators hold impacts below 2**50 and above them the number of dimensions met.
SEEN_BITS = 50
SEEN = 1 << SEEN_BITS
#: Components within this go through the index, so that impacts of up to 4096 dimensions fit.
LARGEST = 1 << 18


class Postings:
    """A shard's vectors (rows of int64) by dimension and value."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)  # exact: components and sums stay below 2**53
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()  # per dimension: rows by ascending value
        self.values = np.take_along_axis(x.T, self.order, axis=1)

    def members(self, q: np.ndarray, k: int, enough: int) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best of q, all of them; and how many postings were read.

        Reading ends when few rows are possible, or after half of all postings: from there on,
        scoring the rows that are possible costs less than reading the rest would.
        """
        n = len(self.x)
        dims = np.flatnonzero(q)
        if n <= max(k, enough) or not len(dims):
            return np.arange(n), 0
        acc, read = np.zeros(n, np.int64), 0  # impacts in the low bits, dimensions met from SEEN up
        w = q[dims]
        low, high = self.values[dims, 0], self.values[dims, -1]
        worst = np.where(w > 0, w * low, w * high)
        top = int((np.where(w > 0, w * high, w * low) - worst).max())
        done = np.zeros(len(dims), np.int64)  # postings read of each dimension
        for step in (*STEPS, 0.0):
            tau = int(top * step)
            for d, j in enumerate(dims):  # impact >= tau, the highest first
                if w[d] > 0:
                    to = n - int(np.searchsorted(self.values[j], -(-(worst[d] + tau) // w[d]), side="left"))
                    part = slice(n - to, n - done[d])
                else:
                    to = int(np.searchsorted(self.values[j], (worst[d] + tau) // w[d], side="right"))
                    part = slice(done[d], to)
                if to > done[d]:
                    rows = self.order[j, part]
                    acc[rows] += w[d] * self.values[j, part] + (SEEN - worst[d])
                    read += len(rows)
                    done[d] = to
            if step == 0.0:
                break
            met = acc & (SEEN - 1)
            least = np.partition(met, n - k)[n - k]  # a lower bound of the k-th best score
            possible = np.flatnonzero(met + (len(dims) - (acc >> SEEN_BITS)) * max(0, tau - 1) >= least)
            if len(possible) <= enough or 2 * read >= n * len(dims):
                return possible, read
        met = acc & (SEEN - 1)
        return np.flatnonzero(met >= np.partition(met, n - k)[n - k]), read


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; where 64 bits may not do, in Python's integers, held to 64 bits at the end."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2.0**62:
        return np.array([min(2**63 - 1, max(-(2**63), sum(int(a) * int(b) for a, b in zip(r, q)))) for r in x], dtype=np.int64)
    return x @ q


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _search(k: int):
    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list, list, list] = [], [], [], []
        if len(qs) and len(xs):
            xs = xs.sort_values(["vec_id", "name"])
            xs = xs.loc[xs.index.repeat(np.minimum(xs.copies, k + 1))]  # more equal rows than k, besides the query's own, can't be among the k best
            width = max(max(map(len, qs.v)), max(map(len, xs.v)))
            ids, names, x = xs.vec_id.to_numpy(), xs.name.to_numpy(), _matrix(xs.v.to_numpy(), width)
            q_all = _matrix(qs.v.to_numpy(), width)
            small = max(int(np.abs(x).max(initial=0)), int(np.abs(q_all).max(initial=0))) < LARGEST and width <= 4096
            index = Postings(x) if small else None
            for qid, name, q in zip(qs.vec_id.to_numpy(), qs.name.to_numpy(), q_all):
                rows = np.arange(len(ids)) if index is None else index.members(q, min(k + 1, len(ids)), max(4 * k, len(ids) // 50))[0]
                own = np.flatnonzero((ids[rows] == qid) & (names[rows] == name))[:1]
                rows = np.delete(rows, own)
                score = _exact(x[rows], q) if index is None else (index.x[rows] @ q.astype(np.float64)).astype(np.int64)
                best = np.lexsort((ids[rows], -score.astype(object) if len(score) and score.min() == -(2**63) else -score))[:k]
                out[0].extend([qid] * len(best))
                out[1].extend([name] * len(best))
                out[2].extend(ids[rows[best]])
                out[3].extend(score[best])
        return pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(("query_id", "name", "vec_id", "score"), out)})

    return run


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v, name, copies): floor(scale * x) of each component; only whole, finite vectors.

    Rows with null vec_id, null vectors, or null, NaN or infinite components take no part. Every
    other row does: rows that share vec_id and v are one row here with their number in ``copies``, and
    ``name`` (64 bits of v) tells rows with one vec_id apart. Other columns are ignored.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(~bad)
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))
    return v.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).select("vec_id", "v", F.xxhash64("v").alias("name"), "copies")


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products with other rows.

    Both frames come from ``quantised``. Candidates are all rows but the query's own, others with its vec_id
    too; each of several query rows with one vec_id gets its own k rows. Ties go to the smaller
    vec_id; fewer than k other rows give all of them. A shorter vector counts as ending in zeros; a vector's
    length is the work of its row. Empty tables give no rows. Blocks of queries meet shards of
    vectors; the numbers of both follow the tables.
    """
    prepare(vectors.sparkSession)
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    cut = lambda n: F.pmod(F.xxhash64("vec_id", "name"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("vec_id", "name", "v", cut(blocks).alias("b")).withColumn("s", every(shards))
    x = vectors.select("vec_id", "name", "copies", "v", cut(shards).alias("s")).withColumn("b", every(blocks))
    found = q.groupBy("b", "s").cogroup(x.groupBy("b", "s")).applyInPandas(_search(k), "query_id long, name long, vec_id long, score long")
    best = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    more = queries.where("copies > 1").select(F.col("vec_id").alias("query_id"), "name", "copies")
    each = ranked.join(more, ["query_id", "name"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return each.select("query_id", "rank", "vec_id", "score")


def op9_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH i AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM i q, i c WHERE q.vec_id % 50 = 0 AND q.row <> c.row),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
