"""What every query needs from the session: a shared folder, written intermediate tables, importable workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches that Python workers hold at once, for sessions that leave Spark's defaults as they are.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000",), "spark.sql.execution.arrow.maxBytesPerBatch": ("-1", "0", "268435456", str((1 << 63) - 1), str((1 << 31) - 1))}
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the session runs from a source tree.

    On a cluster the package is shipped with --py-files or installed; the extra path does no harm there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) in (None, *DEFAULTS.get(key, ())):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or under a local master, where all are one
    process on one machine, a temporary one if that is unset. A cluster without the setting is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "strandweave")
    return base.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/strandweave-{uuid.uuid4().hex[:12]}/{name}"
    atexit.register(_quietly, spark, path.rsplit("/", 1)[0])
    return path


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone when the driver ends
        pass


class Written:
    """A table written to the shared folder, read back without its lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path.rsplit("/", 1)[0])


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it without its lineage."""
    return Written(df, name).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, most: int = 2_000_000) -> DataFrame:
    """Semi or anti join of df with distinct ids. At most `most` of them are broadcast, so that df isn't shuffled; more
    are joined as any table. ids should be cheap to count."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, key, how)
