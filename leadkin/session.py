"""Session settings and the shared folder for cut lineage and stored tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # stored intermediate results go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(app: str = "leadkin", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read; the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="leadkin-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


_FREED: list[list[str]] = []  # folders of stored results, for each `freed` that is open


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read the stored rows and survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    stored = df.checkpoint(eager=True)
    if _FREED:
        folder = stored._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if folder.isDefined():
            _FREED[-1].append(folder.get())
    return stored


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is cut within is deleted at the end, and so are shuffles that nothing refers to any more.

    Otherwise both stay until the driver happens to collect garbage. Only for steps whose results are written within.
    """
    folders: list[str] = []
    _FREED.append(folders)
    try:
        yield
    finally:
        _FREED.pop()
        for folder in folders:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        spark._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Spread an input whose files are too small to give every core a task; leave large ones alone."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    n = 2 * spark.sparkContext.defaultParallelism
    per_task = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(n, key) if size < n * per_task else df
