"""What the operators of this subpackage need from a Spark session."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; documents can be long, so batches stay small.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and lets Python workers import this package.

    On a cluster, ship the package with ``--py-files``; the path set here only
    serves workers that see the driver's file system.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if home not in paths:
        env["PYTHONPATH"] = ":".join([home, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a local folder is set.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tessera-shared-")
    spark.sparkContext.setCheckpointDir(where)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared store, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Spark removes an action's shuffle files when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Kept(list):
    """Tables written by one operator; ``drop()`` removes those not needed any more.

    ``lean``: what was shuffled for a table goes when it is written.
    """

    def __init__(self, spark: SparkSession, lean: bool = False):
        super().__init__()
        self.spark, self.lean = spark, lean

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: writes ``df`` to the shared store and reads it again."""
        path = new_path(self.spark, name)
        with no_shuffle_left(self.spark) if self.lean else nullcontext():
            df.write.option("compression", "zstd").parquet(path)
        self.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder for files that tasks write themselves."""
        self.append(new_path(self.spark, name))
        return self[-1]

    def drop_one(self, at: int) -> None:
        delete(self.spark, self.pop(at))

    def drop(self, keep: int = 0) -> None:
        while len(self) > keep:
            delete(self.spark, self.pop(0))


#: A key with more than one in so many rows is hot: at most this many keys are.
HOT_SHARE = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with one row a key that has in ``n`` how many rows share it.

    Rows of hot keys stay where they are and meet their keys (HOT_SHARE at most) by broadcast;
    only the others are dealt by key.
    """
    is_hot = F.col("n") > max(1, total // HOT_SHARE)
    hot = F.broadcast(keyed.where(is_hot))
    cold = rows.join(F.broadcast(keyed.where(is_hot).select(key)), key, "left_anti").join(keyed.where(~is_hot), key)
    return rows.join(hot, key).unionByName(cold)


def trim() -> None:
    """Gives memory that a worker has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(f):
    """``f`` over a task's batches; an idle worker afterwards holds little beside its modules."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
