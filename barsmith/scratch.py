"""Where intermediate and scratch tables go: the folder that all of a cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


#: Temporary folders by application; the setting itself can't be changed while a session runs.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one JVM (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="barsmith-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")
