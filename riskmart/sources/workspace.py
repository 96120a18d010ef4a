"""Shared folders for intermediate tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only in local mode."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="riskmart-")
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make checkpoint() usable, keeping a folder the session already has."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    context.setCheckpointDir(shared_root(spark))
    return context.getCheckpointDir()


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a run's folder on its own file system, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
