"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage as a checkpoint does, and unlike one it keeps column pruning and
statistics for the plan that reads it. Files outlive the executors that wrote them, so a lost
executor costs only the tasks that were running on it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a folder of our own (local master) or one in the warehouse."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith(("local[", "local")) and not spark.sparkContext.master.startswith("local-cluster"):
            _own[app] = "file://" + tempfile.mkdtemp(prefix="echofold-stage-")
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_echofold_stage"
    return _own[app]


def _path(spark: SparkSession, path: str):
    handle = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back; the files go when the application ends, or by discard.

    df is written in the partitions that it has: fewer files would also mean fewer tasks for what leads to them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    handle, files = _path(spark, path)
    files.deleteOnExit(handle)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage: shuffle files and broadcasts of plans that are done with go only when their plans do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that staged gave and that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path is not None:
        handle, files = _path(df.sparkSession, path)
        files.delete(handle, True)
