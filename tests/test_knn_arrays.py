import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.operators import evaluation, knn


@pytest.fixture(scope="module")
def table(spark):
    """60 vectors of whole numbers, with copies, a zero vector, a short one, one with NaN and a null."""
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in row] for row in rng.integers(0, 9, (60, 6))]
    vecs[7], vecs[9], vecs[11], vecs[13], vecs[50] = vecs[0], [0.0] * 6, [1.0, 2.0], [float("nan")] + vecs[13][1:], None
    return spark.createDataFrame(list(enumerate(vecs)), "id long, vec array<double>")


@pytest.mark.parametrize("metric, arg", [("braycurtis", None), ("canberra", None), ("jaccard", None), ("jensenshannon", None), ("nan_euclidean", None), ("l1", None), ("lp", 3.0), ("lp", 1.5)])
def test_arrays_give_the_pairs_results_without_a_join_of_all(table, metric, arg):
    if metric == "jaccard":  # least and greatest skip what a short vector lacks; by arrays, vectors unlike in length never meet
        table = table.where("id <> 11")
    queries = table.where("id % 5 = 0")
    got = knn.exact_knn(queries, table, 4, metric, arg)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = knn.top_k(knn.pairs(queries, table, metric, arg), 4, metric)
    plain = lambda t: sorted((r.qid, r["rank"], r.id, round(r.dis, 9)) for r in t.collect())
    assert plain(got) == plain(want)


def test_first_results_of_a_range(table):
    queries = table.where("id % 5 = 0")
    for metric, radius in (("l2", 90.0), ("ip", 40.0)):
        whole = sorted(((r.dis, r.qid, r.id) for r in knn.range_search(queries, table, radius, metric).collect()), key=lambda r: (-r[0] if metric == "ip" else r[0], *r[1:]))
        pairs = knn.pairs(queries, table, metric).where(~F.isnan("dis") & ((F.col("dis") > radius) if metric == "ip" else (F.col("dis") < radius)))
        assert sorted((r.dis, r.qid, r.id) for r in pairs.collect()) == sorted(whole) and len(whole) > 100
        got = knn.range_search(queries, table, radius, metric, first=101)
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        assert [(r.dis, r.qid, r.id) for r in got.collect()] == whole[:101]


def test_counts_of_two_range_searches(table):
    queries = table.where("id % 5 = 0")
    a, b = (knn.pairs(queries, table, m).where(~F.isnan("dis") & (F.col("dis") < r)).select("qid", "id") for m, r in (("l1", 16.0), ("l2", 60.0)))
    n = lambda t: {r.qid: r["count"] for r in t.groupBy("qid").count().collect()}
    want = [n(a), n(b), n(a.join(b, ["qid", "id"]))]
    counts = knn.range_counts(queries, table, ("l1", 16.0), ("l2", 60.0))
    got = {r.qid: (r.n_found, r.n_true, r.n_both) for r in counts.collect()}
    assert got == {q: tuple(w.get(q, 0) for w in want) for q in got} and set(got) >= set(want[0])
    shares = {r.qid: (r.precision, r.recall) for r in evaluation.precision_recall_of_counts(counts, queries.select(F.col("id").alias("qid"))).collect()}
    assert shares == {r.qid: (r.precision, r.recall) for r in evaluation.range_precision_recall(a, b, queries.select(F.col("id").alias("qid"))).collect()}
    assert shares[50] == (1.0, 1.0)  # a null vector finds nothing
