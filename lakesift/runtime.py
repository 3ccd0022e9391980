"""Session helpers: tables, the shared folder for cut lineage, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, once per application: Python workers import it by name."""
    sc = spark.sparkContext
    if getattr(sc, "_lakesift_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(SparkFiles.getRootDirectory(), f"lakesift-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lakesift", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._lakesift_shipped = True


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``root`` (one parquet file or folder each)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a
    local folder is made and set, so a machine-local folder is never used on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"lakesift-{uuid.uuid4().hex[:12]}")
    spark.sparkContext.setCheckpointDir(made)
    return jsc.getCheckpointDir().get().rstrip("/")


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """The file system of a path and its path class."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


_WORKSPACES: list[str] = []


def _scratch(spark: SparkSession) -> str:
    """Where intermediate tables go: the innermost open workspace, else a folder of the application, removed when its JVM ends."""
    if _WORKSPACES:
        return _WORKSPACES[-1]
    root = f"{shared_dir(spark)}/lakesift-{spark.sparkContext.applicationId}"
    fs, path = file_system(spark, root)
    fs.mkdirs(path(root))
    fs.deleteOnExit(path(root))
    return root


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside are removed at the end: write a query's result before leaving."""
    path = f"{_scratch(spark)}/work-{uuid.uuid4().hex}"
    _WORKSPACES.append(path)
    try:
        yield path
    finally:
        _WORKSPACES.remove(path)
        fs, hadoop_path = file_system(spark, path)
        fs.delete(hadoop_path(path), True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses; it goes with its workspace, or with the application."""
    return f"{_scratch(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes, as Spark estimates them, up to which ``spread`` may shuffle a table.
SPREAD_LIMIT = 1 << 30


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a plan's result (of a scan: the size of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(scan: DataFrame, *keys: str, tasks_per_core: int = 3) -> DataFrame:
    """``scan`` in enough partitions for costly work on every row.

    A table of at most ``SPREAD_LIMIT`` bytes that arrives in fewer than two partitions a core is shuffled by ``keys``. A larger table stays as
    ``spark.sql.files.maxPartitionBytes`` cut it, on any number of cores. Call it on scans and projections of scans only.
    """
    ship_package(scan.sparkSession)
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(scan) > SPREAD_LIMIT or scan.rdd.getNumPartitions() >= 2 * cores:
        return scan
    return scan.repartition(tasks_per_core * cores, *keys)
