"""Tables written to the cluster's shared folder, used to cut lineage between rounds."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets one temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="vitrine-")
    return _local_dirs[app]


def run_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once and hand back a scan of it: later plans start from the files. They are for a short time and hold much
    text, so they are packed tightly."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_out(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a table of ``write_out`` that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go: Spark deletes them once the driver's garbage collector finds the plans gone,
    which it may not look for while a query runs."""
    gc.collect()
    spark._jvm.System.gc()
