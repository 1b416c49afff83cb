"""The Spark session that tests, bench and examples share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC, AQE and a shuffle width that suits one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Lets executors import this package where neither their search path nor their working folder holds it.

    The package goes as an archive through Spark's own distribution of files, once an application.
    """
    root = Path(__file__).resolve().parent.parent
    paths = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or any(Path(p).resolve() == root for p in paths):
        return
    archive = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "plumbline").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
