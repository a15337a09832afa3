"""Sends this package to the executors, so that functions that run there can import it wherever the session came from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Adds the package's sources to the session's Python files, once an application. Spark serves them from the driver."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="docweave")), "docweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("docweave", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _sent.add(spark.sparkContext.applicationId)
