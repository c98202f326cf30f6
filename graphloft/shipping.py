"""Gives Python workers this package, wherever the session runs."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python path, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloft_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloft-"), "graphloft_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("graphloft", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._graphloft_shipped = True
