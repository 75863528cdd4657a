"""Session helpers shared by every plan."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def local_session(name: str = "echofold", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, the CLI and benchmarks; an active session is reused."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ECHOFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="echofold-ship-")
    archive = os.path.join(folder, "echofold_package.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for path in sorted(_PACKAGE.rglob("*.py")):
            bundle.write(path, path.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
