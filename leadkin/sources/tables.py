"""Reading and writing of the tables around the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadkin import fixed
from leadkin.session import cut


class Files:
    """Small files and listings in whatever store Spark reads; `calls` counts the requests."""

    calls = 0

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        Files.calls += 1
        hadoop = self.jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.conf), hadoop

    def exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def names(self, path: str) -> list[str]:
        """What a folder holds, by one listing; nothing if it is not there."""
        if not self.exists(path):
            return []
        files, at = self._at(path)
        return [s.getPath().getName() for s in files.listStatus(at)]

    def stamp(self, path: str) -> str:
        """Place, size and time of a file."""
        files, at = self._at(path)
        status = files.getFileStatus(at)
        return f"{path} {status.getLen()} {status.getModificationTime()}"

    def write(self, path: str, text: str) -> None:
        files, at = self._at(path)
        out = files.create(at, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        files, at = self._at(path)
        into = files.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
        finally:
            into.close()

    def delete(self, path: str, whole: bool = False) -> None:
        """Takes away a file; a folder with all it holds only if `whole`."""
        files, at = self._at(path)
        files.delete(at, whole)


def exists(spark: SparkSession, path: str) -> bool:
    return Files(spark).exists(path)


def subfolders(spark: SparkSession, path: str, done_only: bool = True) -> list[str]:
    """Names of the folders under a path; by default only those whose write was completed."""
    if not exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(hadoop) if s.isDirectory()]
    return [n for n in names if not done_only or exists(spark, f"{path}/{n}/_SUCCESS")]


def read_table(spark: SparkSession, path: str, row_ord: str = fixed.ROW_ORD) -> DataFrame:
    """CSV with header (all text, byte-order mark allowed) or Parquet.

    Quoted fields may hold line breaks, so a CSV file is read whole by one task;
    keep large tables in Parquet. A table without a row number of its own gets
    one, which follows the order of the lines of a single file; the numbered rows
    are stored, as another scan could cut the files differently.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    csv = path.lower().rstrip("/").endswith((".csv", ".csv.gz"))
    if csv:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.lower().endswith((".xlsx", ".xls")):
        raise ValueError("convert workbooks to CSV or Parquet first")
    else:
        df = spark.read.parquet(path)
    if row_ord in df.columns:
        return df
    numbered = df.withColumn(row_ord, F.monotonically_increasing_id())
    # one CSV file is always one task, so its numbers are the same at every scan
    return numbered if csv and len(df.inputFiles()) == 1 else cut(numbered)


def read_leads(spark: SparkSession, path: str, limit: int = 0, order: str = fixed.ROW_ORD) -> DataFrame:
    leads = read_table(spark, path)
    return leads.orderBy(order).limit(limit) if limit > 0 else leads


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_run(df: DataFrame, root: str, run_id: str) -> str:
    """Snapshot of one run beside those of other runs; writing the run again replaces it."""
    path = f"{root}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    runs = [n for n in subfolders(spark, root) if n.startswith("run_id=")]
    if not runs:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/{max(runs)}")
