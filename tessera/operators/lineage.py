"""Cutting the lineage of iterative plans, and the folders they write."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Only where that is unset and Spark is local (tests) is a local folder taken.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tessera-checkpoints-"))
    return df.checkpoint()


class Files:
    """Names under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(f"{self.root}/{name}"))

    def names(self, folder: str = "") -> list[str]:
        where = self.path(f"{self.root}/{folder}".rstrip("/"))
        return sorted(x.getPath().getName() for x in self.system.listStatus(where)) if self.system.exists(where) else []

    def remove(self, name: str) -> None:
        self.system.delete(self.path(f"{self.root}/{name}"), True)
