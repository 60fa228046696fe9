"""Sessions: how Python workers find this package, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """In local mode, Python workers are told where the driver found this package, whatever folder it runs in. On a
    cluster the package is installed, or shipped with --py-files."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and "-cluster" not in sc.master:
        own = sc.environment.get("PYTHONPATH", "")
        if ROOT not in own.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, own) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tarnfield-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
