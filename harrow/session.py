"""Session factory with the settings that every query relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", app: str = "harrow", **conf: str) -> SparkSession:
    """UTC time zone, adaptive execution with skew-join splitting, Arrow transfer."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    if master.startswith("local"):  # a cluster keeps its own number, which grows with its data
        settings["spark.sql.shuffle.partitions"] = "8"
    settings |= conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables below ``sf_dir``; Spark resolves the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, unless their PYTHONPATH or working folder already has it."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="harrow-ship-")) / "harrow.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "harrow").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
