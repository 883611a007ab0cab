"""Sends the package's code to the executors, so that a job needs no installation on them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_tracewell_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="tracewell-code-")  # the driver serves it; executors fetch it
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = shutil.make_archive(os.path.join(folder, "tracewell"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(name)
        context._tracewell_shipped = True
    return spark
