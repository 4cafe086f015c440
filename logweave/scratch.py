"""Folders for data of one run, on storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in ``spark.checkpoint.dir``; in a temporary folder only where none is set (local runs)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-logweave-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        shared = _own["dir"]
    return f"{shared}/logweave/{uuid.uuid4().hex}"
