"""Brings this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import lodetext

SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's Python files, once an application: workers need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(lodetext.__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodetext-")), "lodetext.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lodetext", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    SHIPPED.add(app)
