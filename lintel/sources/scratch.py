"""A folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDERS: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder below spark.checkpoint.dir, which goes when the application ends.

    A temporary folder stands in where that is unset and the master is local, as in tests on one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir is not set: executors of a cluster share no temporary folder")
            base = "file://" + tempfile.mkdtemp(prefix="lintel-")
        _FOLDERS[sc.applicationId] = f"{base.rstrip('/')}/scratch-{sc.applicationId}"
        atexit.register(_drop, spark, _FOLDERS[sc.applicationId])
    return f"{_FOLDERS[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except (OSError, ConnectionError):  # the gateway went first
        pass
