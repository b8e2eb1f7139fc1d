"""Tables that a step writes once and later queries read."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_paths: dict[tuple[str, str, str, str], str] = {}
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only in a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="harrow-tables-"))


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: Bytes of a table's files for each part that ``spread`` makes.
PART = 4 << 20


def spread(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """``rows`` of the files at ``path`` in parts of about PART of their bytes, by the hash of the columns ``by``.

    A task reads whole row groups, and one may hold a file's every row. Work that costs much more for a row than moving
    it does is so spread evenly, however the files were written.
    """
    fs, target = _file_system(rows.sparkSession, path)
    parts = -(-fs.getContentSummary(target).getLength() // PART)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *by)


def _stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files right below a folder, and below its tables: another stamp for other input."""
    fs, target = _file_system(spark, path)
    found = []
    for one in fs.listStatus(target):
        inner = fs.listStatus(one.getPath()) if one.isDirectory() else [one]
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in inner]
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:16]


def _write(rows: DataFrame, path: str) -> None:
    """Writes a table that goes when the application ends."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    fs, target = _file_system(rows.sparkSession, path)
    fs.deleteOnExit(target)


def written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over the tables below ``sf_dir``: made and written by the first caller of this application.

    It is made again once a file below ``sf_dir`` has changed. The optimizer does not see through a written table, so what
    made it is computed once, and readers read the columns that they need.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), name)
    if key not in _paths:
        path = f"{folder(spark)}/harrow-tables/{key[0]}/{name}-{uuid.uuid4().hex}"
        _write(make(), path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])


def cut(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read back: what uses them more than once does not make them again, and plans stay small."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/harrow-tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _write(rows, path)
    return spark.read.schema(rows.schema).parquet(path)
