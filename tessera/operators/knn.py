"""Exact nearest-neighbour and range joins between a query set and a vector set.

Frames have ``id`` (long) and ``vec`` (array of float). A query set is small next to the
vector set; it is broadcast only under ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES``, counted first.
Beyond that, queries go to every shard of vectors (``beside``, ``blocked_knn``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators.lineage import cut

#: A query set of more rows, or more bytes of tables beside them, is dealt to shards instead of broadcast.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 1 << 26
#: Rows of a shard that a task holds as a matrix.
SHARD_ROWS = 1 << 16
#: The same where every pair may be a result.
RANGE_ROWS = 1 << 12


def _order(metric: str):
    return [F.desc("dis") if metric in distances.SIMILARITIES else F.asc("dis"), F.asc("id")]


def top_k(pairs: DataFrame, k: int, metric: str = "l2", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Best k rows (dis, id) of each query; NaN and null distances never rank; ties to the smaller id.

    Planned as a limit per partition, an exchange and a final limit, so a query's
    candidates never meet in one task.
    """
    window = Window.partitionBy(*by).orderBy(*_order(metric))
    good = pairs.where(F.col("dis").isNotNull() & ~F.isnan("dis"))
    return good.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def beside(base: DataFrame, queries: DataFrame, counted: DataFrame | None = None, row_bytes: int = 0) -> DataFrame:
    """Every row of ``base`` (with an id) beside every row of ``queries``.

    Few queries are broadcast; more are sent once to each of as many shards of ``base`` as there are shuffle
    partitions. ``counted``: a cheaper frame of as many rows; ``row_bytes``: what a row holds beyond a vector.
    """
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes) if row_bytes else BROADCAST_ROWS
    if (queries if counted is None else counted).limit(most + 1).count() <= most:
        return base.crossJoin(F.broadcast(queries))
    shards = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return base.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).join(dealt, "_shard").drop("_shard")


def pairs(queries: DataFrame, base: DataFrame, metric: str = "l2", arg: float | None = None, exclude_self: bool = False, zone: int | None = None) -> DataFrame:
    """(qid, id, dis) of every query against every vector."""
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    out = beside(base.select("id", "vec"), q)
    if exclude_self:
        out = out.where("id <> qid")
    if zone is not None:
        out = out.where(F.abs(F.col("id") - F.col("qid")) > zone)
    return out.select("qid", "id", distances.metric(metric, arg)(F.col("qvec"), F.col("vec")).alias("dis"))


def exact_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", arg: float | None = None, exclude_self: bool = False, zone: int | None = None) -> DataFrame:
    """(qid, rank, id, dis): the k nearest vectors of each query; L2 and inner product by matrix products, others (but Linf) by arrays."""
    if metric in ("l2", "ip"):
        return blocked_knn(queries, base, k, metric, exclude_self=exclude_self, zone=zone)
    if metric not in distances.ARRAYS:
        return top_k(pairs(queries, base, metric, arg, exclude_self, zone), k, metric).select("qid", "rank", "id", "dis")
    measure, best = distances.array_metric(metric, arg), -1.0 if metric in distances.SIMILARITIES else 1.0
    apart = zone if zone is not None else 0 if exclude_self else -1

    def nearest(qids: np.ndarray, ids: np.ndarray, dis: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for qid, row in zip(qids, dis):
            good = np.flatnonzero((np.abs(ids - qid) > apart) & ~np.isnan(row))
            if len(good) > k:
                good = good[best * row[good] <= np.partition(best * row[good], k - 1)[k - 1]]
            out.append(good[np.lexsort((ids[good], best * row[good]))[:k]])
        row = np.concatenate(out)
        query = np.repeat(np.arange(len(qids)), [len(x) for x in out])
        return qids[query], ids[row], dis[query, row]

    def run(blocks: Blocks) -> pd.DataFrame:
        return _frame(("qid", "id", "dis"), [nearest(qids, ids, measure(q, x)) for qids, q, ids, x in blocks])

    return top_k(in_blocks(queries, base, run, "qid long, id long, dis double"), k, metric).select("qid", "rank", "id", "dis")


def range_search(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", first: int | None = None) -> DataFrame:
    """(qid, id, dis) with dis < radius, or dis > radius for similarities; the bound itself is out.

    ``first``: only so many of all queries' results together, best first, ties to the smaller qid, then id.
    """
    measure, similar = distances.array_metric(metric), metric in distances.SIMILARITIES

    def within(qids: np.ndarray, ids: np.ndarray, dis: np.ndarray) -> tuple[np.ndarray, ...]:
        query, row = np.nonzero(dis > radius if similar else dis < radius)
        out = qids[query], ids[row], dis[query, row]
        return out if first is None else _least(out, first, similar)

    def run(blocks: Blocks) -> pd.DataFrame:
        found = [within(qids, ids, measure(q, x)) for qids, q, ids, x in blocks]
        if first is not None and found:
            found = [_least(tuple(np.concatenate(c) for c in zip(*found)), first, similar)]
        return _frame(("qid", "id", "dis"), found)

    shape = (1024, RANGE_ROWS) if first is None else (4096, SHARD_ROWS)  # a task's results are bounded, whatever the radius
    out = in_blocks(queries, base, run, "qid long, id long, dis double", *shape)
    return out if first is None else out.orderBy(F.desc("dis") if similar else F.asc("dis"), "qid", "id").limit(first)


def range_counts(queries: DataFrame, base: DataFrame, found: tuple[str, float], truth: tuple[str, float]) -> DataFrame:
    """(qid, n_found, n_true, n_both) of two range searches (metric, radius), counted where pairs are compared; no pair crosses the network.

    Queries that meet no vector at all are left out.
    """
    searches = [(distances.array_metric(m), m in distances.SIMILARITIES, r) for m, r in (found, truth)]

    def run(blocks: Blocks) -> pd.DataFrame:
        out = []
        for qids, q, _, x in blocks:
            a, b = ((dis > r) if similar else (dis < r) for dis, similar, r in ((f(q, x), similar, r) for f, similar, r in searches))
            out.append((qids, a.sum(1), b.sum(1), (a & b).sum(1)))
        return _frame(("qid", "n_found", "n_true", "n_both"), out)

    parts = in_blocks(queries, base, run, "qid long, n_found long, n_true long, n_both long")
    return parts.groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("n_found", "n_true", "n_both")))


def _least(found: tuple[np.ndarray, ...], n: int, similar: bool) -> tuple[np.ndarray, ...]:
    qid, ident, dis = found
    if len(dis) > n:
        key = -dis if similar else dis
        some = np.flatnonzero(key <= np.partition(key, n - 1)[n - 1])
        some = some[np.lexsort((ident[some], qid[some], key[some]))[:n]]
        qid, ident, dis = qid[some], ident[some], dis[some]
    return qid, ident, dis


def _frame(names: tuple[str, ...], parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*parts))} if parts else {n: [] for n in names})


#: (ids and vectors of some queries, ids and vectors of some rows): vectors of one length.
Blocks = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: Queries compared at once with a shard.
AT_ONCE = 32


def _dealt(queries: DataFrame, base: DataFrame, block: int, shard_rows: int, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (qid, qvec, b, s) and rows (id, vec, s, b): every block b of queries meets every shard s of rows once."""
    spark = base.sparkSession
    queries, base = (t.select("id", "vec").where("vec is not null") for t in (queries, base))
    n_blocks = max(1, -(-queries.count() // block))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // shard_rows))
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("b")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    x = base.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return q, x


def in_blocks(queries: DataFrame, base: DataFrame, run: Callable[[Blocks], pd.DataFrame], schema: str, block: int = 4096, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """What ``run`` makes of each (query block, shard) task; vectors unlike in length never meet, null ones take no part."""
    q, x = _dealt(queries, base, block, shard_rows)

    def blocks(qs: pd.DataFrame, xs: pd.DataFrame) -> Blocks:
        q_size, x_size = qs.qvec.map(len).to_numpy(), xs.vec.map(len).to_numpy()
        for n in np.unique(q_size):
            some, there = np.flatnonzero(q_size == n), np.flatnonzero(x_size == n)
            if len(there):
                rows, ids = _matrix(xs.vec.iloc[there], n), xs.id.to_numpy()[there]
                for i in range(0, len(some), AT_ONCE):
                    part = some[i : i + AT_ONCE]
                    yield qs.qid.to_numpy()[part], _matrix(qs.qvec.iloc[part], n), ids, rows

    def task(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        return run(blocks(qs, xs) if len(qs) and len(xs) else iter(()))

    return q.groupBy("b", "s").cogroup(x.groupBy("b", "s")).applyInPandas(task, schema)


def _matrix(vectors: pd.Series, n: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), n)


def _nearest(xs: np.ndarray, ids: np.ndarray, qs: np.ndarray, qids: np.ndarray, k: int, metric: str, zone: int) -> tuple[np.ndarray, ...]:
    """(query's place, row's place, dis) of each query's k best rows: matrix products choose, differences decide.

    All rows within the products' rounding error of the k-th best are computed exactly, ties go to the smaller id.
    """
    whole = np.isfinite(xs).all(axis=1)
    odd = np.flatnonzero(~whole)  # NaN or infinite: no product chooses them, all are computed
    plain = np.where(whole[:, None], xs, 0.0)
    norms, out = (plain * plain).sum(1), ([], [], [])
    for i in range(0, len(qs), 256):  # bounded memory, however many rows
        part = np.where(np.isfinite(qs[i : i + 256]), qs[i : i + 256], 0.0)
        own = (part * part).sum(1)
        d = -(part @ plain.T) if metric == "ip" else own[:, None] + norms[None] - 2 * (part @ plain.T)
        for j, row in enumerate(d):
            query = qs[i + j]
            apart = np.abs(ids - qids[i + j]) > zone
            good = np.flatnonzero(apart & whole)
            if len(good) > k and np.isfinite(query).all():
                noise = 1e-12 * (own[j] + norms[good].max() + 1.0) * xs.shape[1]
                good = good[row[good] <= np.partition(row[good], k - 1)[k - 1] + noise]
            good = np.concatenate([good, odd[apart[odd]]])
            with np.errstate(invalid="ignore"):
                dis = (xs[good] * query).sum(1) if metric == "ip" else ((xs[good] - query) ** 2).sum(1)
            good, dis = good[~np.isnan(dis)], dis[~np.isnan(dis)]
            best = np.lexsort((ids[good], -dis if metric == "ip" else dis))[:k]
            out[0].append(np.full(len(best), i + j))
            out[1].append(good[best])
            out[2].append(dis[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def blocked_knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", block: int = 4096, shards: int | None = None, exclude_self: bool = False, zone: int | None = None) -> DataFrame:
    """Exact k-NN of a query set of any size by matrix products: (query block, shard) tasks, then a merge.

    Each task holds one block of queries and one shard of about ``SHARD_ROWS`` vectors at most. Distances are in
    double; NaN never ranks, null vectors take no part. ``zone``: only rows whose id is further than that from the query's.
    """
    q, x = _dealt(queries, base, block, SHARD_ROWS, shards)
    apart = zone if zone is not None else 0 if exclude_self else -1

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"qid": [], "id": [], "dis": []})
        a, b = (np.stack([np.asarray(v, dtype=np.float64) for v in s]) for s in (qs.qvec, xs.vec))
        qids, ids = qs.qid.to_numpy(), xs.id.to_numpy()
        query, row, dis = _nearest(b, ids, a, qids, k, metric, apart)
        return pd.DataFrame({"qid": qids[query], "id": ids[row], "dis": dis})

    found = q.groupBy("b", "s").cogroup(x.groupBy("b", "s")).applyInPandas(run, "qid long, id long, dis double")
    return top_k(found, k, metric).select("qid", "rank", "id", "dis")


def one_dimension_knn(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, dis): the k nearest rows (id, x) by abs(x - x'), ties to the smaller id; ids are unique.

    Values are sorted across the cluster once. A value's nearest rows lie among its own and the k next values on each side, of
    which the k + 1 smallest ids are held; tasks get the last and first values of the parts around theirs. Null, NaN and infinite values take no part.
    """
    plain = lambda t: t.select("id", F.col("x").cast("double").alias("x")).where("abs(x) < double('infinity')")
    queries, base, keep = plain(queries), plain(base), k + 1
    spark = base.sparkSession
    least = base.withColumn("_n", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("_n") <= keep)
    values = least.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most k + 1
    asked = queries.select("x").distinct().withColumn("asked", F.lit(True))
    both = values.join(asked, "x", "full").select("x", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), F.coalesce("asked", F.lit(False)).alias("asked"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = cut(both.repartitionByRange(parts, "x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id()))
    reach = 2 * keep

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for pdf in batches:
            pdf = pdf[pdf.ids.map(len) > 0][["part", "x", "ids"]]
            first = pdf.head(reach) if first is None else pd.concat([first, pdf]).head(reach)
            last = pdf.tail(reach) if last is None else pd.concat([last, pdf]).tail(reach)
        if first is not None:
            yield pd.concat([first, last]).drop_duplicates("x")

    held = spark.sparkContext.broadcast(table.mapInPandas(edges, "part int, x double, ids array<long>").toPandas().sort_values("x"))  # 4 k rows a part

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches) or [pd.DataFrame({"x": [], "ids": [], "asked": [], "part": []})])
        if not len(own) or not own.asked.any():
            return
        near, part = held.value, own.part.iloc[0]
        around = pd.concat([near[near.part < part].tail(reach), own[own.ids.map(len) > 0], near[near.part > part].head(reach)])
        xs, ids = around.x.to_numpy(float), np.full((len(around), keep), -1, np.int64)
        there = np.zeros(ids.shape, bool)
        for i, row in enumerate(around.ids):
            ids[i, : len(row)], there[i, : len(row)] = row, True
        todo, wide = own.x[own.asked.astype(bool)].to_numpy(float), k
        while len(todo):
            left = []
            for i in range(0, len(todo), 1 << 14):
                v = todo[i : i + (1 << 14)]
                at = np.searchsorted(xs, v)[:, None] + np.arange(-wide, wide + 1)[None]
                inside = (at >= 0) & (at < len(xs))
                at = np.clip(at, 0, max(len(xs) - 1, 0))
                dis = np.abs(v[:, None] - xs[at]) if len(xs) else np.zeros((len(v), 0))
                good = (there[at] & inside[:, :, None]).reshape(len(v), -1)
                far = np.where(good, np.repeat(dis, keep, axis=1), np.inf)
                names = np.where(good, ids[at].reshape(len(v), -1), np.iinfo(np.int64).max)
                best = np.lexsort((names, far), axis=-1)[:, :keep]
                far, names = np.take_along_axis(far, best, 1), np.take_along_axis(names, best, 1)
                # a value further on can only tie, where differences round to one number
                more = (inside[:, 0] & (at[:, 0] > 0) & (dis[:, 0] <= far[:, -1])) | (inside[:, -1] & (at[:, -1] < len(xs) - 1) & (dis[:, -1] <= far[:, -1]))
                left.append(v[more])
                n = np.isfinite(far).sum(1)
                yield pd.DataFrame({"x": v[~more], "ids": [r[:m] for r, m in zip(names[~more], n[~more])], "dis": [r[:m] for r, m in zip(far[~more], n[~more])]})
            todo, wide = np.concatenate(left), 2 * wide

    answers = table.mapInPandas(run, "x double, ids array<long>, dis array<double>")
    found = queries.select(F.col("id").alias("qid"), "x").join(answers, "x").select("qid", F.arrays_zip("ids", "dis").alias("near"))
    if exclude_self:
        found = found.withColumn("near", F.filter("near", lambda r: r["ids"] != F.col("qid")))
    found = found.select("qid", F.posexplode(F.slice("near", 1, k)).alias("at", "near"))
    return found.select("qid", (F.col("at") + 1).alias("rank"), F.col("near.ids").alias("id"), F.col("near.dis").alias("dis"))


def knn_of_candidates(candidates: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """Distances of given (qid, id) pairs; ids that are not in ``base`` (such as -1) drop out."""
    q = queries.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return candidates.join(q, "qid").join(base.select("id", "vec"), "id").select("qid", "id", distances.metric(metric)(F.col("qvec"), F.col("vec")).alias("dis"))


def refine(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Re-ranks candidates (qid, id) by exact distance."""
    return top_k(knn_of_candidates(found.select("qid", "id").distinct(), queries, base, metric), k, metric).select("qid", "rank", "id", "dis")
