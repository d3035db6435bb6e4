"""Sessions: a local one for tests and bench, and the package on every executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine with UTC timestamps and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sitewright")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once for each application.

    Needed where an executor's path does not hold it already, as on a cluster or
    when the driver was started in another folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp())  # executors fetch the file from here as they start
    atexit.register(shutil.rmtree, folder, True)
    shutil.copytree(root, folder / "stage" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", folder / "stage"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


_CUTS: list[str] = []


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the written table.

    Later stages read files that any executor reaches, so a lost executor costs
    the tasks it was running and nothing that came before the cut. The table has
    the sizes of its files; a checkpointed plan would carry on the estimates of
    its joins, which grow without end in loops.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _CUTS.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_cuts(spark: SparkSession) -> None:
    """Delete every table that ``cut`` wrote in this application."""
    _CUTS.clear()
    _delete(spark, own_dir(spark))


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that ``cut`` writes inside, but for the paths that are put into the given list."""
    before, kept = len(_CUTS), []
    try:
        yield kept
    finally:
        for path in [p for p in _CUTS[before:] if p not in kept]:
            _CUTS.remove(path)
            _delete(spark, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have shuffles of plans that nothing holds any more deleted now: Spark does so once the driver's memory is tidied, which it may not be for long."""
    spark.sparkContext._jvm.System.gc()


def path_of(table: DataFrame) -> str:
    """Where ``cut`` wrote its last table that has this one's files."""
    files = table.inputFiles()
    return next(p for p in reversed(_CUTS) if not files or any(p.split("/")[-1] in f for f in files))
