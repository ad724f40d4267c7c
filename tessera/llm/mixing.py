"""Operator 8: mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the number of times each of its documents is taken:
the whole part as it is, the fractional part as an inclusion probability. The cube method
moves these probabilities through the null space of the constraints (number of documents
and number of words) until they are 0 or 1, so that both totals of a source stay
where they should be. Flights run in buckets of bounded size at the same time; the two
smallest documents or so that each leaves undecided go on to the next level, until one bucket for
each source is left, whose last two land by giving up the constraints one after the other.
A flight settles the largest document first and spreads what that changes over all others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, partitions, prepare

GAPS = r"[\x20\x09-\x0D]+"
#: Documents of a source that fly together.
BUCKET = 4096
#: No document is taken more often.
MOST = 3
_EPS = 1e-9


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size) -> adds target: the total shared by weights 1, 2, 3, repeating.

    Sources in order of code points, null last. A share stops at ``most`` times the source's
    size; what is over goes to the others by weight (water filling, in closed form).
    ``sources`` has one row for each source, which a window puts in order.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("level", "place")
    upto, past = by_level.rowsBetween(Window.unboundedPreceding, 0), by_level.rowsBetween(1, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(most))
    t = sources.withColumn("place", F.row_number().over(ordered)).withColumn("weight", 1.0 + (F.col("place") - 1) % 3)
    t = t.withColumn("level", cap / F.col("weight")).withColumn("total", F.sum("source_size").over(all_).cast("double"))
    t = t.withColumn("rest", F.coalesce(F.sum("weight").over(past), F.lit(0.0))).withColumn("full", F.sum(cap).over(upto))
    t = t.withColumn("capped", F.col("full") + F.col("level") * F.col("rest") <= F.col("total"))
    left = F.max("total").over(all_) - F.sum(F.when(F.col("capped"), cap).otherwise(0.0)).over(all_)
    weights = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(all_)
    t = t.withColumn("left", left).withColumn("weights", weights)
    share = F.when(F.col("capped") | (F.col("weights") == 0), cap).otherwise(F.least(cap, F.col("weight") * F.col("left") / F.when(F.col("weights") > 0, F.col("weights"))))
    return t.select("source", "source_size", share.alias("target"))


def _direction(a: list[tuple[float, float]]) -> tuple[float, float, float]:
    """A vector u with sum u = 0-constraints on (m, m * size) of three units."""
    (m1, s1), (m2, s2), (m3, s3) = a
    u = (m2 * s3 - s2 * m3, s1 * m3 - m1 * s3, m1 * s2 - s1 * m2)
    return u if max(map(abs, u)) > 0 else (m2, -m1, 0.0)


def _step(p: np.ndarray, u: np.ndarray, rng) -> np.ndarray:
    """Moves p along u or against it, up to a face of the cube, without changing its expectation."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)).min()
        down = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)).min()
    by = up if rng.random() * (up + down) < down else -down
    return np.clip(p + by * u, 0.0, 1.0)


def _spread(p: np.ndarray, a: np.ndarray) -> np.ndarray | None:
    """A direction that moves the first unit and makes up for it by all others, those about half taken most."""
    w = p[1:] * (1 - p[1:])
    rest = a[:, 1:]
    m = (rest * w) @ rest.T
    if abs(np.linalg.det(m)) <= 1e-9 * m[0, 0] * m[1, 1]:
        return None  # the others are of one size
    return np.concatenate([[1.0], w * (-np.linalg.solve(m, a[:, 0]) @ rest)])


def fly(p: np.ndarray, count: np.ndarray, size: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Probabilities after the flight: all but two are 0 or 1, with ``land`` all of them.

    count and size (both of all repeats of a unit) are what is balanced. The largest unit is settled
    first, while there are others to make up for it; the last are the smallest.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    p = p.astype(float).copy()
    scale = max(1.0, float(size.max())) if len(size) else 1.0
    a = np.stack([count.astype(float), size / scale])
    left = np.argsort(-size, kind="stable")
    left = left[(p[left] > _EPS) & (p[left] < 1 - _EPS)]
    while len(left) > (0 if land else 2):
        u = _spread(p[left], a[:, left]) if len(left) > 3 else None
        units = left if u is not None else left[-3:]
        if u is None and len(units) == 3:
            u = np.array(_direction([tuple(x) for x in a[:, units].T]))
        elif u is None:
            u = np.array([a[0, units[1]], -a[0, units[0]]] if len(units) == 2 else [1.0])
        moved = _step(p[units], u, rng)
        p[units] = np.where(moved < _EPS, 0.0, np.where(moved > 1 - _EPS, 1.0, moved))
        left = left[(p[left] > 0.0) & (p[left] < 1.0)]
    return p


def _flight(land: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "rid2"], kind="stable").reset_index(drop=True)
        seed = int(np.bitwise_xor.reduce(pdf.rid.to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        p = fly(pdf.p.to_numpy(), pdf.m.to_numpy(), (pdf.m * pdf["size"]).to_numpy(float), seed, land)
        return pdf[["rid", "rid2", "src", "size", "m"]].assign(p=p)

    return run


def choose(units: DataFrame, kept: Kept, bucket: int = BUCKET) -> DataFrame:
    """units (rid, rid2, src, size, m, p) -> (rid, rid2, pick 0 or 1), balanced within each src.

    Bucket and order follow from the units alone, so that reruns agree however rows are dealt. Buckets
    are dealt by source and bucket: a source, however large, is spread over all tasks.
    """
    done = None
    schema = "rid long, rid2 long, src int, size long, m long, p double"
    level = 0
    while True:
        cuts = units.groupBy("src").agg(F.ceil(F.count("*") / bucket).cast("long").alias("cuts"))
        most = cuts.agg(F.max("cuts")).first()[0] or 0
        dealt = units.join(cuts, "src").withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "rid"), F.col("cuts")))
        dealt = dealt.repartition(partitions(units.sparkSession), "src", "bucket")
        out = kept.table(dealt.groupBy("src", "bucket").applyInPandas(_flight(most <= 1), schema), "flown")
        settled = out.where("p = 0 or p = 1").select("rid", "rid2", F.col("p").cast("int").alias("pick"))
        done = settled if done is None else done.union(settled)
        if most <= 1:
            return done
        units, level = out.where("p > 0 and p < 1"), level + 1


def keyed(docs: DataFrame, name: str = "rid") -> DataFrame:
    """Adds a 128-bit name of a row's doc_id, source and text, as two columns."""
    row = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.withColumns({name: F.xxhash64(*row), f"{name}2": F.xxhash64(F.lit("second"), *row)})


def mix(docs: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, rid, rid2.

    size: words of the text (null text: 0); copies: how often the mix takes the row (0 to
    ``most``), taken = copies * size. Null source is a source of its own, the last. A source
    without words has target 0. Wholly repeated rows share their fate. Reruns agree. Other
    columns are ignored, null doc_id stays, an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    kept = Kept(spark)
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), GAPS), "")).cast("long")
    rows = kept.table(keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))).select("rid", "rid2", "doc_id", "source", size.alias("size")), "sizes")
    shares = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    shares = shares.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = kept.table(shares.withColumn("whole", F.floor(ratio + _EPS).cast("int")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole"))), "shares")
    sized = rows.join(shares, rows.source.eqNullSafe(shares.source)).drop(shares.source)
    units = sized.where(F.col("p") > _EPS).groupBy("rid", "rid2", "src", "size", "p").agg(F.count("*").alias("m")).select("rid", "rid2", "src", "size", "m", "p")
    picks = choose(kept.table(units, "units"), kept, bucket)
    copies = F.col("whole") + F.coalesce("pick", F.lit(0))
    columns = ["doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "rid", "rid2"]
    return sized.join(picks, ["rid", "rid2"], "left").select(*columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes it.

    Nulls as in ``mix``: null text has size 0 and is taken as its source's share says, null source is a source. Each of
    wholly repeated rows comes that often. Other columns come along; an empty table gives no rows.
    """
    times = mix(docs).where("copies > 0").select(F.col("rid").alias("__rid"), F.col("rid2").alias("__rid2"), F.col("copies").alias("__copies")).distinct()
    return keyed(docs, "__rid").join(times, ["__rid", "__rid2"]).withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)
