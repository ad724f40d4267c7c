"""Inverted lists: a table (list_no, id, vec or code, o2c) beside a small centroid model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators import knn, models

#: Queries, and entries of a list, that a task of ``batch_search`` holds.
PART_ROWS = 1 << 14


def build(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list_no, id, vec, o2c): every vector in the list of its nearest centroid; o2c is that squared distance."""
    return models.assign(vectors, centroids).select("list_no", "id", "vec", F.col("dis").alias("o2c"))


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """(qid, qvec, probe, list_no, q2c): the lists a query visits, nearest first."""
    p = models.assign(queries, centroids, nprobe)
    return p.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("rank").alias("probe"), "list_no", F.col("dis").alias("q2c"))


def candidates(probed: DataFrame, lists: DataFrame, max_codes: int | None = None, selector: Column | None = None, zone: int | None = None) -> DataFrame:
    """Joins probes to lists on list_no; optionally within a budget of codes, an id predicate and an exclusion zone.

    ``max_codes``: lists are visited in probe order until so many entries were seen; the list that
    passes the budget is still read.
    """
    if max_codes is not None:
        sizes = lists.groupBy("list_no").agg(F.count("*").alias("n"))
        seen = F.sum("n").over(Window.partitionBy("qid").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1))
        probed = probed.join(sizes, "list_no").withColumn("seen", F.coalesce(seen, F.lit(0))).where(F.col("seen") < max_codes).drop("n", "seen")
    out = probed.join(lists, "list_no")
    if selector is not None:
        out = out.where(selector)
    if zone is not None:
        out = out.where(F.abs(F.col("id") - F.col("qid")) > zone)
    return out


def search(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, k: int, nprobe: int, metric: str = "l2", **options) -> DataFrame:
    """(qid, rank, id, dis): approximate k-NN over the probed lists' raw vectors."""
    c = candidates(probes(queries, centroids, nprobe), lists, **options)
    return knn.top_k(c.select("qid", "id", distances.metric(metric)(F.col("qvec"), F.col("vec")).alias("dis")), k, metric).select("qid", "rank", "id", "dis")


def batch_search(probed: DataFrame, lists: DataFrame, k: int, part: int = PART_ROWS) -> DataFrame:
    """(qid, rank, id, dis): all queries of a list meet its entries at once, as matrix products.

    A task holds at most about ``part`` queries and as many entries of a list and sends k rows a query on.
    """
    sizes = lambda t, c: t.groupBy("list_no").agg(F.ceil(F.count("*") / part).cast("int").alias(c))
    cuts = sizes(probed, "asked").join(sizes(lists, "held"), "list_no")
    deal = lambda t, key, own, other, n, m: t.join(cuts, "list_no").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    q = deal(probed.select("qid", "qvec", "list_no"), "qid", "a", "h", "asked", "held").select("list_no", "a", "h", "qid", "qvec")
    x = deal(lists.select("list_no", "id", "vec"), "id", "h", "a", "held", "asked").select("list_no", "a", "h", "id", "vec")

    def run(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"qid": [], "id": [], "dis": []})
        qids, ids = qs.qid.to_numpy(), xs.id.to_numpy()
        query, row, dis = knn._nearest(models.matrix(xs.vec), ids, models.matrix(qs.qvec), qids, k, "l2", -1)
        return pd.DataFrame({"qid": qids[query], "id": ids[row], "dis": dis})

    found = q.groupBy("list_no", "a", "h").cogroup(x.groupBy("list_no", "a", "h")).applyInPandas(run, "qid long, id long, dis double")
    return knn.top_k(found, k).select("qid", "rank", "id", "dis")


def range_search(queries: DataFrame, lists: DataFrame, centroids: np.ndarray, radius: float, nprobe: int, metric: str = "l2") -> DataFrame:
    c = candidates(probes(queries, centroids, nprobe), lists)
    dis = distances.metric(metric)(F.col("qvec"), F.col("vec"))
    out = c.select("qid", "id", dis.alias("dis"))
    return out.where(F.col("dis") > radius if metric in distances.SIMILARITIES else F.col("dis") < radius)


def deduplicated(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one entry for each distinct vector of a list, members): the first id stands for all equal ones."""
    groups = lists.groupBy("list_no", "vec").agg(F.min("id").alias("id"), F.min("o2c").alias("o2c"), F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.select("list_no", "id", "vec", "o2c"), groups.select(F.col("id").alias("first_id"), F.explode("ids").alias("id"))


def expand(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Search results over distinct entries, with every equal vector's id, cut to k again."""
    out = found.withColumnRenamed("id", "first_id").join(members, "first_id").select("qid", "id", "dis")
    return knn.top_k(out, k).select("qid", "rank", "id", "dis")


def list_statistics(lists: DataFrame) -> DataFrame:
    """(list_no, size, radius): entries and the largest root of o2c."""
    return lists.groupBy("list_no").agg(F.count("*").alias("size"), F.max(F.sqrt("o2c")).alias("radius"))


def merge_lists(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """Entries of two indexes over the same centroids; b's ids are shifted."""
    return a.unionByName(b.withColumn("id", F.col("id") + shift))


def stop_words(lists: DataFrame, most: int) -> DataFrame:
    """Only lists of fewer than ``most`` entries."""
    return lists.join(lists.groupBy("list_no").count().where(F.col("count") < most).select("list_no"), "list_no", "left_semi")


def masked(a: DataFrame, b: DataFrame) -> DataFrame:
    """A list of a if it has entries, else b's."""
    return a.unionByName(b.join(a.select("list_no").distinct(), "list_no", "left_anti"))


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Lists of several indexes side by side: (lists, number of lists) each shifts those after it."""
    out, shift = None, 0
    for lists, n in parts:
        moved = lists.withColumn("list_no", F.col("list_no") + shift)
        out, shift = moved if out is None else out.unionByName(moved), shift + n
    return out
