"""Bringing this package to the executors: they need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a context."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False) or not PACKAGE.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{PACKAGE.name}.zip")  # read by this driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._tessella_shipped = True
