"""Tables in the cluster's shared folder that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, a folder that the driver and all executors share.

    Where it is unset, a session whose driver and executors are one process (master local) gets a folder of its own; any other raises, as
    its executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Writes tables under the shared folder; what is left of them goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def _hadoop(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self) -> str:
        if not self.n:
            files, base = self._hadoop(self.base)
            files.mkdirs(base)
            files.deleteOnExit(base)
        self.n += 1
        return f"{self.base}/{self.n}"

    def write(self, df: DataFrame, *folders: str) -> DataFrame:
        """The table read back; a filter on one of the columns `folders` reads those folders only."""
        path = self.path()
        (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that write() made and that no lazy result reads any more."""
        for df in frames:
            if path := getattr(df, "scratch_path", None):
                files, place = self._hadoop(path)
                files.delete(place, True)
