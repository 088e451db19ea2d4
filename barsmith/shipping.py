"""Sends the package to executors, which do not share the driver's sys.path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(top):
        path = os.path.join(tempfile.mkdtemp(prefix="barsmith-"), "barsmith.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        out.write(whole, os.path.relpath(whole, os.path.dirname(top)))
        context.addPyFile(path)
    _SENT.add(context.applicationId)
