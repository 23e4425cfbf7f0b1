"""Tables between stages in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a session that runs in one process (tests, the bench) and names none
    gets a local one; on a cluster a folder has to be named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandline-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


class Stage:
    """Tables written to the shared folder, to cut lineage: a lost executor re-reads them instead of recomputing. The
    folder goes when the driver's JVM ends; tables that are done with can go before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/strandline/{uuid.uuid4().hex}"
        path, system = self._at("")
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, name: str) -> tuple:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, system = self._at(name)
        system.delete(path, True)
