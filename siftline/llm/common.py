"""What the corpus operators share: word patterns, shared-folder tables, hash-salted helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls 9 to 13 (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"
#: The same for Python's re.
WORD_PY = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker works on at once.
SLICE = 512
#: What a Python worker keeps between the tasks of one operator.
remembered: dict = {}


def forget() -> None:
    """Drop what this Python worker has kept for another operator: Spark gives one worker the tasks of all."""
    remembered.clear()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows: what a worker makes of these, not of all rows of a batch, is in memory at once."""
    forget()
    for b in batches:
        for i in range(0, len(b), SLICE):
            yield b.slice(i, SLICE)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siftline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Stash:
    """Tables written to the shared folder to cut lineage; survives the loss of any executor.

    What isn't dropped before is deleted when the driver's JVM ends, since results may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._system(self.base).deleteOnExit(self._path(self.base))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        """Write and reread df; also its path, for drop()."""
        df.write.option("compression", "zstd").parquet(to := self.path())
        return self.spark.read.schema(df.schema).parquet(to), to

    def keep(self, df: DataFrame) -> DataFrame:
        return self.put(df)[0]

    def bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """Write and reread df, bucketed by keys as finely as a shuffle would deal it out: joins on all
        of them leave this side where it is. The table's name is needed for the writing only."""
        n = min(100_000, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"siftline_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", self.path()).bucketBy(n, *keys).saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files are outside the warehouse and stay
        return table

    def drop(self, *paths: str) -> None:
        """Delete tables that nothing reads any more, and let Spark delete the shuffles that made them."""
        for path in paths:
            self._system(path).delete(self._path(path), True)
        self.spark.sparkContext._jvm.System.gc()


def packed(df: DataFrame, *names: str) -> DataFrame:
    """df's row as the struct _row, beside the columns named; _row.* gives the rows back, so that no
    name of ours can clash with one of df's."""
    own = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(F.struct(*map(own, df.columns)).alias("_row"), *map(own, names))


def share(rows: int, most: int) -> float:
    """The share of rows to take by a hash, so that about most are taken, and hardly ever more."""
    return 1.0 if rows <= most else max(0.0, most - 4 * most**0.5) / rows


def taken(key: Column, part: float) -> Column:
    """Whether a row belongs to the share, by a hash of its key: nothing is sorted or gathered for it."""
    return F.pmod(F.xxhash64(F.lit(77), key), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))


def words_in(text: Column) -> Column:
    """The number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
