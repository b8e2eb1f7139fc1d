"""Cutting lineage: intermediate tables go to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_names: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session has a temporary folder, and a cluster
    is an error: its executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="harrow-")
    return _own_folder[app]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Later steps depend on files that every executor reaches, so a lost executor costs a task, not the
    lineage. The files are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/harrow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    # Spark deletes the shuffle files behind this table once the driver's garbage collector has found them
    # unused, which by itself may take half an hour
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored_in_buckets(df: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
    """Like ``stored``, as a table with ``buckets`` by ``columns``: grouping by them needs no shuffle of what is read.

    Rows should come with this partitioning, so that each task writes one bucket.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/harrow/{spark.sparkContext.applicationId}/{own}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *columns).saveAsTable(own)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    spark.sparkContext._jvm.System.gc()
    out = spark.table(own)
    _paths[out], _names[out] = path, own
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` or ``stored_in_buckets`` has written and that nothing reads any more."""
    for table in tables:
        system, target = _file_system(table.sparkSession, _paths.pop(table))
        if name := _names.pop(table, None):
            table.sparkSession.sql(f"DROP TABLE {name}")
        system.delete(target, True)
