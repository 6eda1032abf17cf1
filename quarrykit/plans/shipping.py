"""The package for the Python workers of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/quarrykit", "zip", root, "quarrykit")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
