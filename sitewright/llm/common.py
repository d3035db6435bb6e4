"""What the operators of this subpackage share: tables, cut lineage, temporary names."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sitewright import session
from sitewright.session import delete_cuts, ship

#: Rows to an Arrow batch, and bytes; texts are long, and a worker holds a batch or two at once.
BATCH_ROWS = "2000"
BATCH_BYTES = str(16 << 20)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where it has Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark's readers touch the path."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the folder that all executors share, and return the written table."""
    small_batches(df.sparkSession)
    return session.cut(df, name)


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Hold ``df`` on the executors' disks for the queries that read it again.

    Unlike ``cut`` this leaves the lineage, so what a lost executor held is made
    again from the inputs; it is for tables near the inputs that would otherwise
    be written as many small files.
    """
    small_batches(df.sparkSession)
    df = df.persist(StorageLevel.DISK_ONLY)
    _KEPT.append(df)
    return df


def release_kept() -> None:
    """Drop what ``keep`` holds."""
    while _KEPT:
        _KEPT.pop().unpersist()


def release(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application, and drop what ``keep`` holds."""
    release_kept()
    delete_cuts(spark)
