"""Sessions, and the package for workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(master: str = "local[8]", partitions: int = 8, **more: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.master(master).appName("ticklane")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=conf | more).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once an application, unless they find it by path or working directory.

    Plans of many columns make methods that the JVM never compiles (over 8,000 bytes): there Spark is told to make smaller ones.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    app = spark.sparkContext.applicationId
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if app in _shipped or any(p and Path(p).resolve() == ROOT for p in paths):
        return
    path = Path(tempfile.mkdtemp(prefix="ticklane-")) / "ticklane.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((ROOT / "ticklane").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
