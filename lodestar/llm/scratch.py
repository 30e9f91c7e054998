"""Shared scratch space and table helpers of the training-data operators.

Intermediate tables are written to the folder named by ``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
costs a re-read and never a recomputation of the whole job.  Only where that setting is absent (tests, a laptop) a folder of our own
is used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .textvec import trim

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the context's checkpoint folder; a temporary one, removed at exit, only where
    neither is set and the session is a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by the worker.
BATCH_ROWS, _BATCH, _DEFAULT = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the scratch root and return the table read back (lineage is cut there).

    A session that has Spark's own batch size gets BATCH_ROWS from here on; another setting stays."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_ROWS)
    path = f"{scratch_root(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table written by :func:`persist_table` (Hadoop file system, so any store works)."""
    path = getattr(df, "_lodestar_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate tables of one job, dropped together behind their last reader."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def own(self, df: DataFrame) -> DataFrame:
        self.held.append(df)
        return df

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.own(persist_table(df, name))

    def drop(self) -> None:
        for df in self.held:
            drop_table(df)
        self.held.clear()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: they stay until the driver happens to collect its garbage.  The driver's own
    freed memory goes back too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session: explicit repartitions follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
