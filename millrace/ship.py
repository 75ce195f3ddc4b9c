"""Give the executors this package."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package as a zip file through Spark's own file server, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = tempfile.mkdtemp(prefix="millrace_zip_")
    os.makedirs(f"{at}/src")
    shutil.copytree(root, f"{at}/src/millrace", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/millrace", "zip", f"{at}/src"))
    shutil.rmtree(f"{at}/src")
    _shipped.add(app)
