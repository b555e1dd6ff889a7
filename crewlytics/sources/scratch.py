"""A folder every executor can reach, for checkpoints and written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where every task runs on this machine, may go without the
    setting and gets a temporary folder.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="crewlytics-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
