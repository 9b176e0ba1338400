"""Shared scratch tables and graph components.

Intermediate tables are Parquet below ``spark.checkpoint.dir``, the one folder that
the driver and all executors share.  They cut lineage, so a lost executor
costs only tasks that re-read them.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from svspark.operators.graph import star_components

#: A side of a join with at most this many rows of a few longs may be broadcast.
BROADCAST_ROWS = 200_000
#: Batches to Python workers hold at most about so many bytes, unless the session has a setting of its own.
BATCH_BYTES = 4 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, as in tests, a temporary one where that is unset."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="svspark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among ``columns``, whatever the case of their letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of batches to Python workers: a batch of 10,000 long texts or sets would not fit beside its neighbours."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def trim() -> None:
    """Give memory that this process has freed back to the system, where the C library can; small arrays leave much of it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Workspace:
    """Names tables in a folder of their own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        trim()
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def save(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back."""
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._svspark_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that ``save`` returned and nothing reads any more."""
        path = getattr(df, "_svspark_path", None)
        if path:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows <= limit else df


def components(work: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (v, label), label the least vertex of v's component; vertices without an edge are not returned.

    Each round is a written table, the number of rounds follows the logarithm of the diameter, and the driver sees one count a round.
    """
    found = star_components(edges, a, b, save=lambda df: work.save(df, "edges"), drop=work.drop)
    return work.save(found.select(F.col("vertex").alias("v"), F.col("component").alias("label")), "labels")
