"""Gives the executors this package where they do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Adds the package to the context as a zip file, once a context."""
    context = spark.sparkContext
    if getattr(context, "_veilspark_shipped", False):
        return
    at = os.path.join(tempfile.mkdtemp(), "veilspark.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(n for n in names if n.endswith((".py", ".txt"))):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(at)
    context._veilspark_shipped = True
