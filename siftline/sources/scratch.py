"""Tables written on the way, to cut lineage: they survive the loss of any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local master that names
    none gets one folder for each application; the session's settings stay as they are."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _own[context.applicationId]


class Scratch:
    """Written and reread tables of one job. What isn't dropped before goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = self._path(self.base)
        self._system(path).deleteOnExit(path)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        to = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._scratch = to
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = self._path(t._scratch)
            self._system(path).delete(path, True)
