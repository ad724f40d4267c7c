"""Vector files (fvecs, ivecs, bvecs), saved indexes and synthetic sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_KINDS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}


def parse(content: bytes, kind: str) -> np.ndarray:
    """Records of a little-endian int32 dimension and that many values; all of one dimension."""
    dtype, width = _KINDS[kind]
    if not content:
        return np.zeros((0, 0), dtype)
    d = int(np.frombuffer(content, "<i4", 1)[0])
    rows = np.frombuffer(content, "u1").reshape(-1, 4 + d * width)
    if (rows[:, :4].copy().view("<i4") != d).any():
        raise ValueError("vectors of different dimensions")
    return rows[:, 4:].copy().view(dtype)


def record(vec: np.ndarray, kind: str) -> bytes:
    return np.array([len(vec)], "<i4").tobytes() + np.asarray(vec, dtype=_KINDS[kind][0]).tobytes()


def read(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(path, id, vec): one task for each file; id counts within the file. Keep files under 1 GB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content):
                x = parse(content, kind)
                for i in range(0, len(x), 10_000):
                    part = x[i : i + 10_000].astype(np.float64)
                    yield pd.DataFrame({"path": name, "id": np.arange(i, i + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, id long, vec array<double>")


def to_records(vectors: DataFrame, kind: str = "fvecs") -> DataFrame:
    """(id, record): the bytes of each vector's record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "record": [record(v, kind) for v in pdf.vec]})

    return vectors.select("id", "vec").mapInPandas(run, "id long, record binary")


def save_index(path: str, spec: dict, lists: DataFrame, **model: np.ndarray) -> None:
    """Lists partitioned by list_no, models and a manifest, each as its own table."""
    spark = lists.sparkSession
    lists.write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/lists")
    rows = [(n, list(map(int, a.shape)), a.astype(float).ravel().tolist()) for n, a in model.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    spark.createDataFrame([(json.dumps(spec, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_index(spark: SparkSession, path: str) -> tuple[dict, DataFrame, dict[str, np.ndarray]]:
    spec = json.loads(spark.read.text(f"{path}/manifest").first().value)
    model = {r.name: np.array(r.numbers).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/models").collect()}
    return spec, spark.read.parquet(f"{path}/lists"), model


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """Rows of several shards under successive ids."""
    out, shift = None, 0
    for s in shards:
        moved = s.withColumn("id", F.col("id") + shift)
        shift += (s.agg(F.max("id")).first()[0] or -1) + 1
        out = moved if out is None else out.unionByName(moved)
    return out


def synthetic(spark: SparkSession, d: int, n: int, seed: int = 1338, inner: int = 10) -> DataFrame:
    """(id, vec): sine of a random linear map of ``inner`` normal variables; rows are made in the tasks."""
    rng = np.random.default_rng(seed)
    a, f = rng.random((inner, d)), rng.random(d) * 4 + 0.1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.random.default_rng([seed, int(i)]).normal(size=inner) for i in pdf.id]) if len(pdf) else np.zeros((0, inner))
            yield pd.DataFrame({"id": pdf.id, "vec": list(np.sin(x @ a * f))})

    return spark.range(n).mapInPandas(run, "id long, vec array<double>")


def split(vectors: DataFrame, parts: int) -> DataFrame:
    """Adds part: successive runs of ids of about one size."""
    return vectors.withColumn("part", F.ntile(parts).over(Window.orderBy("id")) - 1)
