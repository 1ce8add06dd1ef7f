"""Sends this package to the executors, where the path of the driver's copy is not theirs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package, by Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file as long as the application lives
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
