"""Making this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless they share this machine and its path has it."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    local = spark.sparkContext.master.startswith("local[")
    if app in _shipped or local and str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in package.rglob("*.py"):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
