"""What a session needs before tasks run this package's Python code."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application.

    The archive is served by the driver, so the executors need no shared folder for it.
    """
    context = spark.sparkContext
    if getattr(context, "_docquarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docquarry-")) / "docquarry.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(archive))
    context._docquarry_shipped = True
