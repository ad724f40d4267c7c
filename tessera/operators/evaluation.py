"""Measures of search results and of anomaly scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """(recall): share of queries whose true nearest is among the first r."""
    hit = truth.where("rank = 1").select("qid", F.col("id").alias("true_id")).join(found.where(F.col("rank") <= r).select("qid", "id"), "qid", "left")
    per = hit.groupBy("qid").agg(F.max((F.col("id") == F.col("true_id")).cast("int")).alias("hit"))
    return per.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def intersection(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """(qid, common): members both have among their first r."""
    cut = lambda t: t.where(F.col("rank") <= r).select("qid", "id")
    return truth.select("qid").distinct().join(cut(found).join(cut(truth), ["qid", "id"]).groupBy("qid").count(), "qid", "left").select("qid", F.coalesce("count", F.lit(0)).alias("common"))


def range_precision_recall(found: DataFrame, truth: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, precision, recall) of (qid, id) results: no result has precision 1, no truth recall 1."""
    n = lambda t, c: t.groupBy("qid").agg(F.count("*").alias(c))
    t = ids.join(n(found, "n_found"), "qid", "left").join(n(truth, "n_true"), "qid", "left").join(n(found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]), "n_both"), "qid", "left")
    return _shares(t)


def precision_recall_of_counts(counts: DataFrame, ids: DataFrame) -> DataFrame:
    """The same from (qid, n_found, n_true, n_both)."""
    return _shares(ids.join(counts, "qid", "left"))


def _shares(t: DataFrame) -> DataFrame:
    t = t.na.fill(0)
    ratio = lambda b: F.when(F.col(b) == 0, 1.0).otherwise(F.col("n_both") / F.when(F.col(b) > 0, F.col(b)))
    return t.select("qid", ratio("n_found").alias("precision"), ratio("n_true").alias("recall"))


def precision_recall_curve(found: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall) of results cut at each threshold (dis < threshold)."""
    spark = found.sparkSession
    t = spark.createDataFrame([(float(v),) for v in thresholds], "threshold double")
    flagged = found.join(truth.select("qid", "id", F.lit(1).alias("good")), ["qid", "id"], "left")
    cut = F.broadcast(t).join(flagged, F.col("dis") < F.col("threshold"), "left")
    n_true = truth.agg(F.count("*").alias("n_true"))
    g = cut.groupBy("threshold").agg(F.count("dis").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("hits")).crossJoin(F.broadcast(n_true))
    return g.select("threshold", F.when(F.col("n") == 0, 1.0).otherwise(F.col("hits") / F.when(F.col("n") > 0, F.col("n"))).alias("precision"), F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("hits") / F.when(F.col("n_true") > 0, F.col("n_true"))).alias("recall"))


def pareto(points: DataFrame, by: str | None = None) -> DataFrame:
    """Operating points (key, perf, t) that no other point beats: more perf than all that take less time."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("t", F.desc("perf"), "key").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("before", F.max("perf").over(w)).where(F.col("before").isNull() | (F.col("perf") > F.col("before"))).drop("before")


def events(labels: DataFrame, length: int) -> DataFrame:
    """(series_id, event, begin, end): runs of label 1, begun ``length`` - 1 positions earlier (0 at least)."""
    w = Window.partitionBy("series_id").orderBy("t")
    runs = labels.withColumn("start", ((F.col("label") == 1) & (F.coalesce(F.lag("label").over(w), F.lit(0)) == 0)).cast("int")).withColumn("event", F.sum("start").over(w)).where("label = 1")
    return runs.groupBy("series_id", "event").agg(F.greatest(F.lit(0), F.min("t") - (length - 1)).alias("begin"), F.max("t").alias("end"))


def event_precision(scores: DataFrame, found_events: DataFrame, length: int) -> DataFrame:
    """(series_id, n_events, n_hits, precision): greedy over scores, from the highest, ties by id.

    As many alarms as events; an alarm inside an unused event uses it up, and every alarm silences ids within
    ``length`` of it. The scan is sequential, one series to a task.
    """

    def run(key, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        left = sorted(zip(e.begin, e.end))
        n, hits, alarms, silent = len(left), 0, 0, set()
        for i in s.dropna().sort_values(["score", "id"], ascending=[False, True]).id:
            if alarms >= n:
                break
            if i in silent:
                continue
            alarms += 1
            hit = next((x for x in left if x[0] <= i <= x[1]), None)
            if hit:
                hits += 1
                left.remove(hit)
            silent.update(range(i - length, i + length + 1))
        return pd.DataFrame({"series_id": [key[0]], "n_events": [n], "n_hits": [hits], "precision": [hits / n if n else None]})

    return scores.groupBy("series_id").cogroup(found_events.groupBy("series_id")).applyInPandas(run, "series_id string, n_events long, n_hits long, precision double")
