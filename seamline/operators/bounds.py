"""Sizes of partitions, and results that are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 24 << 20  # of source text; its segments then sort in memory


def partitions_for(text_bytes: int, at_least: int) -> int:
    """Hash partitions for so much source text, and no fewer than the session asks for."""
    return max(at_least, -(-text_bytes // PARTITION_BYTES))


def settle(df: DataFrame) -> DataFrame:
    """Compute the rows once: into the cluster's checkpoint folder, or the cache if it names none."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; a local one only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seamline-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
