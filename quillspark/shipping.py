"""Bring the package to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def archive(path: str) -> str:
    """Write the package's modules to a zip that Python can import from; gives the path back."""
    root = os.path.dirname(os.path.abspath(__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


def ship(spark: SparkSession) -> None:
    """Send the package to every executor of a session, those that join later too."""
    folder = tempfile.mkdtemp(prefix="quillspark-")  # the driver's own; Spark serves the file to executors
    spark.sparkContext.addPyFile(archive(os.path.join(folder, "quillspark.zip")))
